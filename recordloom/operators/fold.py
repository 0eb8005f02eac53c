"""The last-write-wins fold: a log of upserts and deletes in order of arrival becomes one row per URI.

For each URI, in order of ``seq``: an upsert is accepted if its time is not before the latest accepted
one, a delete likewise but only after a first upsert; a delete of a deleted record just moves its
time. Whether a mutation is accepted depends only on the running maximum of the times before it, so
the fold is one shuffle on the URI and window functions. The result does not depend on how a log is
cut into batches. Mutations of a URI that share a ``seq`` come by their times, then by op and cid (ARRIVAL), so that
the result depends on the log alone and not on the order in which a shuffle brings it.

A URI that holds more than a share of the log is *hot*: its rows are cut into slices along ``seq``, so that no task
gets them all. A slice needs to know of the ones before it whether an upsert came, the latest
accepted time and the last accepted op; these are maxima of what each slice has by itself, taken
over the slices, of which there are few.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from recordloom.errors import IndexError_
from recordloom.schema import FEED, RECORD_COLUMNS

#: Times are kept in 63 bits; others are skipped, or refused by ``validated``.
LATEST = (1 << 63) - 1
_SEED = "__seed"
#: The order of a URI's mutations.
ARRIVAL = ["seq", "indexed_at", "op", "cid"]
#: A URI is hot beyond so many rows, if they are more than one of so many parts of the log.
HOT, SHARE = 10_000, 1000
#: Slices of a hot URI, of all of them together, and rows that they are laid out by.
SLICES, CUTS, SAMPLE = 128, 1024, 8192


def in_range(mutations: DataFrame) -> DataFrame:
    """Without mutations whose time is null, negative or beyond 63 bits."""
    return mutations.where((F.col("indexed_at") >= 0) & (F.col("indexed_at") <= LATEST)).withColumn("indexed_at", F.col("indexed_at").cast("long"))


def validated(mutations: DataFrame) -> DataFrame:
    """The mutations, or an error if any time is out of range: all or none."""
    bad = mutations.where("indexed_at is null or indexed_at < 0").union(mutations.where(F.col("indexed_at") > LATEST))
    if not bad.isEmpty():
        raise IndexError_("a batch holds a time out of range; nothing is stored")
    return mutations


def with_state(mutations: DataFrame, state: DataFrame | None) -> DataFrame:
    """The log with the state before it as mutations that come first: an upsert, and a delete for a tombstone.

    ``seq`` is a long, or a struct of two (batch, place in it).
    """
    log = mutations.withColumn(_SEED, F.lit(False))
    if state is None:
        return log
    columns = ["cid", "did", "collection", "rkey", "record_json", "indexed_at"]
    kind = mutations.schema["seq"].dataType
    before = lambda n: F.lit(n).cast("long") if kind == LongType() else F.struct(F.lit(n), F.lit(0)).cast(kind)
    first, gone = F.struct(before(-2).alias("seq"), F.lit("U").alias("op")), F.struct(before(-1).alias("seq"), F.lit("D").alias("op"))
    # one reading of the state, which may be a fold itself
    seed = state.select(F.explode(F.when(F.col("is_deleted"), F.array(first, gone)).otherwise(F.array(first))).alias("__e"), "uri", *columns)
    return log.unionByName(seed.select("__e.seq", "__e.op", "uri", *columns, F.lit(True).alias(_SEED)))


def accepted(log: DataFrame) -> DataFrame:
    """The mutations that have an effect on the time or the content of their record, with ``before`` (the op before).

    This counts the rows of each URI first, to find the hot ones; without any the rest is one plan. The state has two rows
    of a URI at most and is not counted, as it may be a fold that would be computed for it.
    """
    rows = log.where("uri is not null")
    hot = _hot(rows.where(~F.col(_SEED)))
    if not hot:
        return _accepted(rows)
    is_hot = F.col("uri").isin(hot)
    return _accepted(rows.where(~is_hot)).unionByName(_accepted_in_slices(rows.where(is_hot), len(hot)))


def _accepted(rows: DataFrame) -> DataFrame:
    arrival = Window.partitionBy("uri").orderBy(*ARRIVAL)
    earlier = arrival.rowsBetween(Window.unboundedPreceding, -1)
    # over the same order as the others, so that rows are sorted once
    rows = rows.withColumn("__first", F.min(F.when(F.col("op") == "U", F.col("seq"))).over(arrival.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.where("seq >= __first").withColumn("__latest", F.max("indexed_at").over(earlier))
    rows = rows.where("__latest is null or indexed_at >= __latest")
    return rows.withColumn("before", F.lag("op").over(arrival)).drop("__first", "__latest")


def _hot(rows: DataFrame) -> list[str]:
    """URIs of more than HOT rows that hold more than one of SHARE parts of all rows; fewer than SHARE, so they go through the driver."""
    counts = rows.groupBy("uri").agg(F.count("*").alias("n"))
    least = counts.where(F.col("n") > HOT)
    if least.isEmpty():
        return []
    total = counts.agg(F.sum("n")).first()[0]
    return [r["uri"] for r in least.where(F.col("n") * SHARE > total).select("uri").collect()]


def _accepted_in_slices(rows: DataFrame, uris: int) -> DataFrame:
    """``accepted`` for a few URIs of many rows each. Slices end at the quantiles of a sample of ``seq``."""
    some = rows.orderBy(F.xxhash64("uri", "seq")).limit(SAMPLE).select("seq")
    cuts = min(SLICES * uris, CUTS)
    ends = sorted(r["seq"] for r in some.collect())
    ends = list(dict.fromkeys(ends[len(ends) * i // cuts] for i in range(1, cuts)))
    # one literal: an array of a thousand would be as many expressions
    kind = ArrayType(rows.schema["seq"].dataType)
    known = F.from_json(F.lit(json.dumps([e.asDict() if isinstance(e, Row) else e for e in ends])), kind)
    before = F.size(F.filter(known, lambda e: e <= F.col("seq")))
    sliced = rows.withColumn("__slice", before)
    part = ["uri", "__slice"]
    arrival = Window.partitionBy(*part).orderBy(*ARRIVAL)
    up = F.col("op") == "U"
    rows = sliced.withColumn("__first", F.min(F.when(up, F.col("seq"))).over(Window.partitionBy(*part)))
    # what a slice has by itself: a first upsert, and the latest time of all of it and from that upsert on
    own = rows.groupBy(*part).agg(
        F.first("__first").alias("first"), F.max("indexed_at").alias("all"), F.max(F.when(F.col("seq") >= F.col("__first"), F.col("indexed_at"))).alias("from_first")
    )
    slices = Window.partitionBy("uri").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.max(F.col("first").isNotNull()).over(slices), F.lit(False))
    own = own.withColumn("begun", begun).withColumn("latest", F.when(F.col("begun"), F.col("all")).otherwise(F.col("from_first")))
    known = own.select(*part, "begun", F.max("latest").over(slices).alias("so_far"))
    rows = rows.join(F.broadcast(known), part)  # a row for each slice of fewer than SHARE URIs
    rows = rows.where("begun or seq >= __first")
    latest = F.greatest("so_far", F.max("indexed_at").over(arrival.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__latest", latest).where("__latest is null or indexed_at >= __latest")
    last = rows.groupBy(*part).agg(F.max_by("op", F.struct(*ARRIVAL)).alias("op"))
    last = last.select(*part, F.last("op", ignorenulls=True).over(slices).alias("__op"))
    rows = rows.join(F.broadcast(last), part).withColumn("before", F.coalesce(F.lag("op").over(arrival), "__op"))
    return rows.drop("__first", "__latest", "__slice", "__op", "begun", "so_far")


def fold(mutations: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The records after ``mutations`` (schema MUTATIONS), from ``state`` or from nothing."""
    rows = accepted(with_state(in_range(mutations), state))
    content, place = F.struct("cid", "did", "collection", "rkey", "record_json"), F.struct(*ARRIVAL)
    folded = rows.groupBy("uri").agg(
        F.max_by(F.when(F.col("op") == "U", content), F.when(F.col("op") == "U", place)).alias("r"),
        F.max("indexed_at").alias("indexed_at"),
        (F.max_by("op", place) == "D").alias("is_deleted"),
    )
    return folded.select("uri", "r.*", "indexed_at", "is_deleted").select(*RECORD_COLUMNS)


def feed(mutations: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """What really changed (schema FEED): every accepted upsert, and deletes of active records without payload."""
    rows = accepted(with_state(in_range(mutations), state)).where(f"not {_SEED}")
    upsert = F.col("op") == "U"
    rows = rows.where(upsert | (F.col("before") == "U"))
    keep = lambda c: F.when(upsert, F.col(c)).alias(c)
    return rows.select(
        "seq", F.when(upsert, "Upsert").otherwise("Delete").alias("change"), "uri", "did", "collection", "rkey",
        keep("cid"), keep("record_json"), keep("indexed_at"),
    ).select(*[f.split()[0] for f in FEED.split(", ")])


def stats(mutations: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row: upserted, deleted, skipped (out of range)."""
    fine = F.coalesce((F.col("indexed_at") >= 0) & (F.col("indexed_at") <= LATEST), F.lit(False))
    kinds = feed(mutations, state).select("change").union(mutations.where(~fine).select(F.lit("Skipped")))
    count = lambda kind: F.count_if(F.col("change") == kind)
    return kinds.agg(count("Upsert").alias("upserted"), count("Delete").alias("deleted"), count("Skipped").alias("skipped"))


def soft_deleted_unversioned(state: DataFrame, uris: DataFrame) -> DataFrame:
    """The state with these URIs (column uri) marked deleted, their times unchanged."""
    marks = uris.select("uri").distinct().withColumn("__gone", F.lit(True))
    joined = state.join(marks, "uri", "left")
    return joined.withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__gone", F.lit(False))).select(*RECORD_COLUMNS)


def hard_deleted(state: DataFrame, uris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state without these URIs, and the deletes to announce: one for each row removed, tombstones included."""
    keys = uris.select("uri").distinct()
    removed = state.join(keys, "uri", "left_semi").select(F.lit("Delete").alias("change"), "uri", "did", "collection", "rkey")
    return state.join(keys, "uri", "left_anti").select(*RECORD_COLUMNS), removed


def is_upsert(change: Column | str = "change") -> Column:
    """Whether a change of the feed is an upsert; the others are deletes."""
    return (F.col(change) if isinstance(change, str) else change) == "Upsert"


def record_of_change() -> Column:
    """The record that a change of the feed wrote, as a struct; null for a delete."""
    return F.when(is_upsert(), F.struct("uri", "cid", "did", "collection", "rkey", "record_json", "indexed_at", F.lit(False).alias("is_deleted")))


def matching(changes: DataFrame, collection: str | None = None, did: str | None = None) -> DataFrame:
    """The changes of a collection, of a DID, or of both."""
    rows = changes if collection is None else changes.where(F.col("collection") == collection)
    return rows if did is None else rows.where(F.col("did") == did)


def replayed(feed_rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """What a slow reader still gets: the last ``capacity`` changes, rounded up to a power of two."""
    kept = 1 << max(capacity - 1, 0).bit_length()
    return feed_rows.orderBy(F.desc("seq")).limit(kept)


def lag(feed_rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: published, and skipped by a reader that read nothing."""
    kept = 1 << max(capacity - 1, 0).bit_length()
    return feed_rows.agg(F.count("*").alias("published")).withColumn("skipped", F.greatest(F.col("published") - kept, F.lit(0).cast("long")))
