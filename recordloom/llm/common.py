"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one of so many parts of the rows; so there are fewer than HEAVY such keys.
HEAVY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one set on the context, or named in ``spark.checkpoint.dir``.

    Where neither is there, local mode (one process, as in tests) takes a temporary folder; on a cluster
    no folder of one machine would do, and an error says so.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="recordloom-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage is cut, a lost executor loses nothing.

    The tables stay there, as results that are not yet computed may read them; the folder is the cluster's to clear.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, values: DataFrame, keys: Sequence[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values``, which have one row for each key and in ``count`` how many rows hold it.

    Keys that hold more than a HEAVYth of all rows are fewer than HEAVY, so their values are sent to every
    task; the other rows meet theirs in a shuffle, in which no key is large. Both sides are read
    twice, so they should be tables. ``how`` is inner or left; keys must not be null.
    """
    keys = list(keys)
    total = values.agg(F.sum(count)).first()[0] or 0
    heavy = values.where(F.col(count) > total / HEAVY)
    hot = rows.join(F.broadcast(heavy), keys)
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(values.where(F.col(count) <= total / HEAVY), keys, how)
    return hot.unionByName(cold)


def tidied(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``f``, a function of Arrow batches, that gives memory back at the end of its task.

    Python workers are reused by later stages; what allocators keep for themselves would pile up beside
    the executor's heap.
    """

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
            if trim is not None:
                trim(0)

    return run


def pieces(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """The array in slices of about ``size`` bytes of text, so that results far larger than the texts stay small."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
        held += n or 0
        if held >= size:
            yield texts.slice(start, i - start)
            start, held = i, 0
    if start < len(texts) or not len(texts):
        yield texts.slice(start)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def finite(vector: Column) -> Column:
    """Whether an array of doubles is there, holds something, and no null or non-finite number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Arrays of one length, none of them null, as the rows of a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
