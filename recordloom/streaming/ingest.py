"""Ingestion with Structured Streaming: frames in, records and change feed out.

Every micro-batch is one batch of the store, known by its stream and number, so that a batch that is run again
changes nothing, whatever else the store has seen in between. Late frames are never dropped: the fold resolves them.
Backpressure, resuming and draining are the source's options, the checkpoint and the trigger. A batch is
read once: what is counted is observed on the way to the store.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from recordloom.operators import fold, frames
from recordloom.operators.metrics import observed as read_off
from recordloom.sources.store import RecordStore


def file_frames(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of frames, one a line, with the place they were read from (see ``numbered``)."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return lines.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def numbered(batch: DataFrame) -> DataFrame:
    """``batch`` with seq: files in the order of their names, lines in the order of their places.

    The files of a batch are few, by the source's limit; their numbers are sent to all tasks.
    """
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    places = batch.select("file", "block").distinct().orderBy("file", "block").collect()
    known = batch.sparkSession.createDataFrame([(r["file"], r["block"], i) for i, r in enumerate(places)], "file string, block long, place long")
    rows = batch.withColumn("line", line).join(F.broadcast(known), ["file", "block"])
    return rows.select("value", (F.shiftleft("place", 33) + F.col("line")).alias("seq"))


def apply_batch(
    store: RecordStore, batch: DataFrame, batch_id: int, collections: Sequence[str] = (), dids: Sequence[str] = (), single: bool = False,
    writer: str = "stream", rejected_path: str | None = None,
) -> dict[str, int]:
    """Fold one batch of frames (value and seq, or value, file and block) into the store, and count.

    ``writer`` and ``batch_id`` say which batch it is; one that was applied before changes nothing. Counts: frames,
    bytes, rejected (frames that mean nothing and commits that cannot be meant), upserted, deleted, skipped (times out of range) and
    sync_errors (creates and updates without a record). The cursor moves with all commits, wanted or not. ``single`` counts as
    records that are applied one by one do: every upsert counts, stale or not, and those without a record do
    not move the cursor. With ``rejected_path`` rejected frames are written there, under writer and batch, with their reasons.
    """
    rows = batch if "seq" in batch.columns else numbered(batch)
    came, held, kept = Observation(), Observation(), Observation()
    e, time = F.col("event"), F.col("event.time_us")
    commit = e["event_type"] == "commit"
    fails = commit & (e["operation"] != "delete") & e["record_json"].isNull()
    moves = commit & ~fails if single else commit
    rows = rows.observe(came, F.count("*").alias("frames"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))
    events = frames.judged(rows)
    if rejected_path:  # the second output would read the batch again
        events = events.persist()
    try:
        wanted = frames.is_wanted(collections, dids)
        observed = events.observe(
            held, F.nullif(F.max(F.when(moves, time)), F.lit(0).cast("long")).alias("cursor"), F.count_if(wanted & fails).alias("sync_errors"),
            F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        )
        log = frames.mutations_of(observed.where(wanted))
        in_range = (F.col("indexed_at") >= 0) & (F.col("indexed_at") <= fold.LATEST)
        log = log.observe(kept, F.count_if((F.col("op") == "U") & in_range).alias("upserts"))
        if rejected_path:
            bad = events.where(F.col("reason").isNotNull()).select("seq", "value", "reason")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/writer={writer}/batch={batch_id}")
        before = store.applied(writer, batch_id)
        counts = store.apply(log, lambda: read_off(held, cursor=None)["cursor"], writer=writer, number=batch_id)
        if before:
            return dict.fromkeys(("frames", "bytes", "rejected", "sync_errors"), 0) | counts
        found = read_off(held, sync_errors=0, rejected=0)
        counts = read_off(came, frames=0, bytes=0) | counts | {k: found[k] for k in ("sync_errors", "rejected")}
        if single:
            counts["upserted"] = read_off(kept, upserts=0)["upserts"]
        return counts
    finally:
        if rejected_path:
            events.unpersist()


def start(
    source: DataFrame, store: RecordStore, checkpoint: str, collections: Sequence[str] = (), dids: Sequence[str] = (),
    on_batch: Callable[[int, dict[str, int]], None] | None = None, drain: bool = True, single: bool = False, rejected_path: str | None = None,
) -> StreamingQuery:
    """Run a stream of frames (value, seq) into the store; ``drain`` stops when the source has no more.

    The stream is known to the store by the identity that its checkpoint holds, so another checkpoint starts anew.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        name = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        counts = apply_batch(store, batch, batch_id, collections, dids, single, f"stream-{name or checkpoint}", rejected_path)
        if on_batch:
            on_batch(batch_id, counts)

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


class Telemetry(StreamingQueryListener):
    """What the session's streams have done, by the identity in their checkpoint: starts, restarts, batches, rows and the last activity."""

    def __init__(self) -> None:
        self.streams: dict[str, dict] = {}

    def _of(self, query_id) -> dict:
        return self.streams.setdefault(str(query_id), {"starts": 0, "restarts": 0, "batches": 0, "rows": 0, "last_activity": None, "error": None})

    def onQueryStarted(self, event) -> None:
        seen = self._of(event.id)
        seen["starts"] += 1
        seen["restarts"] = seen["starts"] - 1
        seen["last_activity"] = event.timestamp

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = self._of(progress.id)
        seen["batches"] += 1
        seen["rows"] += max(0, progress.numInputRows)
        seen["last_activity"] = progress.timestamp

    def onQueryIdle(self, event) -> None:
        self._of(event.id)["last_activity"] = event.timestamp

    def onQueryTerminated(self, event) -> None:
        self._of(event.id)["error"] = event.exception
