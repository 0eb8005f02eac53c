"""Times of the stream: microseconds, ISO-8601 text and resume cursors. The session's zone plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in microseconds.
FUTURE = 5 * 365 * 86_400_000_000
OVERLAP = 5_000_000
WINDOW = 72 * 3_600_000_000


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def _iso(seconds: Column) -> Column:
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    clock = F.concat(two(rest / 3600), F.lit(":"), two(F.pmod(rest, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(rest, F.lit(60))))
    return F.concat(F.date_format(days, "yyyy-MM-dd"), F.lit("T"), clock)


def iso_millis(millis: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ``; times before 1970 are shown as 1970."""
    millis = F.greatest(millis.cast("long"), F.lit(0).cast("long"))
    return F.concat(_iso(F.floor(millis / 1000)), F.lit("."), F.lpad(F.pmod(millis, F.lit(1000)).cast("string"), 3, "0"), F.lit("Z"))


def iso_seconds(seconds: Column) -> Column:
    return F.concat(_iso(seconds.cast("long")), F.lit("Z"))


def now_iso() -> Column:
    return iso_millis(F.unix_millis(F.current_timestamp()))


def is_valid_time(micros: Column, now: Column | None = None) -> Column:
    """Not more than five years ahead of now (microseconds)."""
    return micros <= (F.unix_micros(F.current_timestamp()) if now is None else now) + FUTURE


def resume_cursor(cursor: Column, now: Column) -> Column:
    """Where to read on: five seconds back, at most 72 hours; null for no cursor."""
    zero = F.lit(0).cast("long")
    return F.when(cursor > 0, F.nullif(F.greatest(cursor - OVERLAP, now - WINDOW, zero), zero))


def reconnect_cursor(cursor: Column) -> Column:
    """Where to read on after a lost connection: five seconds back; null for no cursor."""
    return F.when(cursor > 0, F.greatest(cursor - OVERLAP, F.lit(0).cast("long")))
