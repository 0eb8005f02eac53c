"""Stream frames: JSON text to typed events, on batch and streaming DataFrames alike.

A frame is dropped unless it is one well-formed JSON object whose fields have the right types. The
types are looked up in a VARIANT, since decoding with a schema would convert wrong ones silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import identifiers as ids
from recordloom.functions.once import once
from recordloom.functions.timefmt import is_valid_time

_FIELDS = ("did", "kind", "time_us", "commit", "commit.operation", "commit.collection", "commit.rkey", "commit.cid")
_U64 = "18446744073709551615"


#: Why a frame is dropped, or means no more than its time.
REASONS = ("no frame", "time too late", "no time", "bad commit")


def parsed(frames: DataFrame, value: str = "value", now: Column | None = None) -> DataFrame:
    """``frames`` with an ``event`` struct; frames that mean nothing are left out."""
    return judged(frames, value, now).where(F.col("event.event_type").isNotNull()).drop("reason")


def rejected(frames: DataFrame, value: str = "value", now: Column | None = None) -> DataFrame:
    """``frames`` with ``reason``: those that are dropped, and commits that cannot be meant, of which the time is used at most."""
    return judged(frames, value, now).where(F.col("reason").isNotNull()).drop("event")


def judged(frames: DataFrame, value: str = "value", now: Column | None = None) -> DataFrame:
    """All ``frames`` with an ``event`` struct, whose event_type is null for those that mean nothing, and the ``reason`` (see REASONS).

    event: event_type (commit, heartbeat, other), did, time_us, kind, operation, collection, rkey, cid,
    record_json. ``now`` (microseconds) bounds times, five years ahead; it is the current time if not
    given. Times beyond 63 bits come out as null.

    A text is parsed once, and once more for the record of a commit if that is asked for.
    """
    # as an array: what stands after the frame makes a second element or no array
    rows = once(frames, "__d", F.try_parse_json(F.concat(F.lit("["), F.col(value), F.lit("]"))))
    at = lambda path, kind="string": F.try_variant_get("__d", path, kind)
    types = F.struct(*[F.schema_of_variant(at(f"$[0].{f}", "variant")).alias(f.replace(".", "_")) for f in _FIELDS])
    fields = F.struct(
        (F.schema_of_variant(at("$[0]", "variant")).startswith("OBJECT") & at("$[1]", "variant").isNull()).alias("whole"),
        types.alias("is"),
        at("$[0].did").alias("did"),
        at("$[0].kind").alias("kind"),
        F.coalesce(at("$[0].time_us", "decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).alias("t"),
        *[at(f"$[0].commit.{f}").alias(f) for f in ("operation", "collection", "rkey", "cid")],
    )
    rows = once(rows, "__f", fields)
    f, is_ = F.col("__f"), F.col("__f.is")
    absent = lambda k: k.isNull() | (k == "VOID")
    text = lambda k: absent(k) | (k == "STRING")
    inside = lambda k: k.isNull() | (k == "STRING")
    time, t = is_["time_us"], f["t"]
    shape = (
        f["whole"]
        & text(is_["did"])
        & text(is_["kind"])
        & (absent(time) | (time == "BIGINT") | time.rlike(r"^DECIMAL\((19|20),0\)$"))
        & t.between(F.lit(0).cast("decimal(20,0)"), F.lit(_U64).cast("decimal(20,0)"))
        & (absent(is_["commit"]) | is_["commit"].startswith("OBJECT"))
        & inside(is_["commit_operation"])
        & inside(is_["commit_collection"])
        & inside(is_["commit_rkey"])
        & text(is_["commit_cid"])
    )
    operation = ids.operation_of(f["operation"])
    good = ids.is_valid_did(f["did"]) & ids.is_valid_collection(f["collection"]) & ids.is_valid_rkey(f["rkey"]) & operation.isNotNull()
    is_commit = f["kind"] == "commit"
    shaped, early = F.coalesce(shape, F.lit(False)), F.coalesce(is_valid_time(t, now), F.lit(False))
    is_good = is_commit & F.coalesce(good, F.lit(False))
    of = lambda kind, reason: F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(reason).cast("string").alias("reason"))
    verdict = (
        F.when(~shaped, of(None, "no frame"))
        .when(~early, of(None, "time too late"))
        .when(is_good, of("commit", None))
        .when(is_commit, F.when(t > 0, of("heartbeat", "bad commit")).otherwise(of(None, "bad commit")))
        .when(~(t > 0), of(None, "no time"))
        .otherwise(F.when(f["kind"].isNull(), of("heartbeat", None)).otherwise(of("other", None)))
    )
    rows = once(rows, "__k", verdict)
    k = F.col("__k.kind")
    of_commit = lambda x: F.when(k == "commit", x)
    event = F.struct(
        k.alias("event_type"),
        F.when(k != "heartbeat", ids.trimmed(f["did"])).alias("did"),
        t.try_cast("long").alias("time_us"),
        F.when(k == "other", f["kind"]).alias("kind"),
        of_commit(operation).alias("operation"),
        of_commit(ids.trimmed(f["collection"])).alias("collection"),
        of_commit(f["rkey"]).alias("rkey"),
        of_commit(f["cid"]).alias("cid"),
        of_commit(F.get_json_object(value, "$.commit.record")).alias("record_json"),
    )
    return rows.withColumn("event", event).withColumn("reason", F.col("__k.reason")).drop("__d", "__f", "__k")


def is_wanted(collections: list[str] = (), dids: list[str] = ()) -> Column:
    """Whether an event is a commit of these collections and DIDs; an empty list wants all."""
    yes = F.col("event.event_type") == "commit"
    if collections:
        yes &= F.col("event.collection").isin(*collections)
    if dids:
        yes &= F.col("event.did").isin(*dids)
    return F.coalesce(yes, F.lit(False))


def wanted(events: DataFrame, collections: list[str] = (), dids: list[str] = ()) -> DataFrame:
    """Commits of these collections and DIDs; an empty list wants all. Other events go."""
    return events.where(is_wanted(collections, dids))


def timestamps(frames: DataFrame, value: str = "value", now: Column | None = None) -> DataFrame:
    """``frames`` with ``time_us``, the time of every frame that means anything."""
    return parsed(frames, value, now).withColumn("time_us", F.col("event.time_us")).drop("event")


def commits(frames: DataFrame, value: str = "value", now: Column | None = None) -> DataFrame:
    """``frames`` that are commits, with their fields as columns."""
    return wanted(parsed(frames, value, now)).select("*", "event.*").drop("event", "event_type", "kind")


def cursor(events: DataFrame, kinds: tuple[str, ...] = ("commit",)) -> DataFrame:
    """One row: the largest time of these kinds of events, null for none. Zero is no time."""
    return events.where(F.col("event.event_type").isin(*kinds)).agg(F.nullif(F.max("event.time_us"), F.lit(0).cast("long")).alias("cursor"))


def mutations_of(commits: DataFrame, seq: str = "seq") -> DataFrame:
    """Commits as mutations. Creates and updates without a record have no effect and are left out."""
    e = F.col("event")
    rows = commits.where("event.event_type = 'commit' and (event.operation = 'delete' or event.record_json is not null)")
    return rows.select(
        F.col(seq).cast("long").alias("seq"),
        F.when(e["operation"] == "delete", "D").otherwise("U").alias("op"),
        ids.format_uri(e["did"], e["collection"], e["rkey"]).alias("uri"),
        F.coalesce(e["cid"], F.lit("")).alias("cid"),
        e["did"].alias("did"),
        e["collection"].alias("collection"),
        e["rkey"].alias("rkey"),
        e["record_json"].alias("record_json"),
        e["time_us"].alias("indexed_at"),
    )
