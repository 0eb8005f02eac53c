"""Row numbers of a global order without a task that sees all rows.

Rows are dealt by ranges of the order, sorted in their partitions and written with their place in the
partition. The sizes of the partitions, of which there are as many as tasks, give each one its offset by a
prefix sum, and a row's number is its partition's offset and its place.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.sources.scratch import written

#: ``monotonically_increasing_id`` counts a partition's rows in the lower bits.
_BITS = 33


def numbered(rows: DataFrame, order: Sequence[Column | str], keep: Sequence[str] | None = None, name: str = "number") -> DataFrame:
    """The columns ``keep`` of ``rows`` (all of them, if not given) and ``name``, a row's place in ``order`` from 0 on.

    This runs: the ordered rows are written once to the shared folder. Rows that tie are numbered in
    some order of theirs, so the order should end in a key. No rows give no rows.
    """
    keep = list(rows.columns if keep is None else keep)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.select(*keep, F.monotonically_increasing_id().alias("__at")))
    part = F.shiftright("__at", _BITS)
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())  # a row for each task
    offsets = [0, *accumulate(n for _, n in sizes)]
    known = rows.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(sizes, offsets)], "__part long, __offset long")
    joined = placed.withColumn("__part", part.cast("long")).join(F.broadcast(known), "__part")
    return joined.select(*keep, (F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << _BITS) - 1))).alias(name))
