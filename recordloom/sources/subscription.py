"""A subscription to a change stream as a streaming data source whose offsets are the stream's cursor.

A micro-batch is the frames after one time up to another. Its time is cut into slices, and each slice is read in a task of its own,
over a connection that asks for the wanted collections and DIDs and starts at the slice's cursor; so nothing passes through
the driver, and a task that is lost reads its slice again. A connection that breaks within a slice is made anew five
seconds before the last frame seen. Frames may hence come twice, which the fold does not mind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from recordloom.functions.timefmt import OVERLAP
from recordloom.sources.pages import subscription_url
from recordloom.sources.paged import _lines

#: seq orders frames as they came: the time so far in the upper bits.
SCHEMA = "value string, seq long"
_SEQ_BITS = 10
#: Connections for one slice before it fails.
TRIES = 10


class Transport(Protocol):
    def latest(self, url: str) -> int:
        """The time of the newest frame there is, 0 for none."""

    def frames(self, url: str) -> Iterator[str]:
        """The frames from the URL's cursor on, in their order; ends or raises when the connection does."""


@dataclass
class _Slice(InputPartition):
    after: int
    until: int


def _time(frame: str) -> int | None:
    """The time of a frame; of what is none, none."""
    try:
        time = json.loads(frame).get("time_us")
    except (ValueError, AttributeError):
        return None
    return time if isinstance(time, int) and not isinstance(time, bool) and 0 <= time < 1 << 63 - _SEQ_BITS else None


class _Reader(DataSourceStreamReader):
    def __init__(self, transport: Transport, base: str, collections: list[str], dids: list[str], cursor: int, span: int, slices: int):
        self.transport, self.cursor, self.span, self.slices = transport, cursor, span, slices
        self.url = lambda at: subscription_url(base, collections, dids, at)
        self.at = cursor

    def initialOffset(self) -> dict:
        return {"cursor": self.cursor}

    def latestOffset(self) -> dict:
        """At most ``span`` beyond the last batch, so that a long absence is caught up with in steps."""
        newest = self.transport.latest(self.url(None))
        self.at = max(self.at, min(newest, self.at + self.span) if self.at else newest)
        return {"cursor": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        a, b = start["cursor"], end["cursor"]
        self.at = max(self.at, b)
        n = max(1, min(self.slices, b - a)) if a else 1
        edges = [a + (b - a) * i // n for i in range(n + 1)]
        return [_Slice(x or -1, y) for x, y in zip(edges, edges[1:]) if y > x]  # a frame may have the time 0

    def read(self, partition: _Slice) -> Iterator[tuple]:
        last, seq, tries, at = partition.after, partition.after << _SEQ_BITS, 0, partition.after
        while True:
            came = False
            try:
                for frame in self.transport.frames(self.url(at)):
                    time = _time(frame)
                    if time is not None and time > partition.until:
                        return
                    if time is None or time > (partition.after if tries == 0 else at):
                        came, last = True, max(last, time or 0)
                        seq = max(seq + 1, last << _SEQ_BITS)
                        yield frame, seq
                return
            except ConnectionError:
                tries = 1 if came else tries + 1
                if tries >= TRIES:
                    raise
                # back by the overlap, but not before the slice: what comes before it is another one's
                at = max(last - OVERLAP, partition.after)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def subscribe(
    spark: SparkSession, transport: Transport, base: str, collections: list[str] = (), dids: list[str] = (), cursor: int | None = None,
    span: int = 3_600_000_000, slices: int = 8,
) -> DataFrame:
    """A stream of frames (schema SCHEMA) for ``ingest.start``, after ``cursor`` (microseconds), else from the first frame on.

    A batch holds at most ``span`` microseconds of the stream, in up to ``slices`` tasks. A query that goes on from its checkpoint
    goes on exactly where it stopped; overlaps are for connections that break.
    """
    name = f"subscription-{uuid.uuid4().hex}"
    wanted = (list(collections), list(dids))

    class Subscription(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Reader(transport, base, *wanted, cursor or 0, span, slices)

    spark.dataSource.register(Subscription)
    return spark.readStream.format(name).load()


class Recorded:
    """A transport over recorded frames, JSON lines in the files of a folder in the order of their names.

    Like a server it sends frames from the cursor on, and commits only of what is wanted.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def latest(self, url: str) -> int:
        return max((_time(line) or 0 for line in _lines(self.folder)), default=0)

    def frames(self, url: str) -> Iterator[str]:
        asked = parse_qs(urlsplit(url).query)
        cursor = int(asked.get("cursor", ["0"])[0])
        for line in _lines(self.folder):
            if (_time(line) or 0) >= cursor and _sent(line, asked):
                yield line


def _sent(frame: str, asked: dict[str, list[str]]) -> bool:
    try:
        read = json.loads(frame)
    except ValueError:
        return True
    commit = read.get("commit") if isinstance(read, dict) else None
    if not isinstance(commit, dict):
        return True
    return (commit.get("collection") in asked.get("wantedCollections", [commit.get("collection")])) and (read.get("did") in asked.get("wantedDids", [read.get("did")]))


class WebSocket:
    """The transport of a live stream, by the package ``websocket-client`` where it is installed."""

    def __init__(self, idle_seconds: float = 30):
        self.idle_seconds = idle_seconds

    def latest(self, url: str) -> int:
        return next((t for f in self.frames(url) if (t := _time(f))), 0)

    def frames(self, url: str) -> Iterator[str]:
        try:
            import websocket
        except ModuleNotFoundError as e:
            raise RuntimeError("a live stream needs the package websocket-client") from e
        connection = websocket.create_connection(url, timeout=self.idle_seconds)
        try:
            while True:
                try:
                    frame = connection.recv()
                except websocket.WebSocketTimeoutException:
                    return
                except websocket.WebSocketException as e:
                    raise ConnectionError(str(e)) from e
                yield frame if isinstance(frame, str) else frame.decode("utf-8", "replace")
        finally:
            connection.close()
