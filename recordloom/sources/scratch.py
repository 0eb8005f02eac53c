"""Tables that live as long as a computation needs them, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from recordloom.errors import ConfigError


def shared_folder(spark: SparkSession) -> str:
    """The folder set on the context, or named in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="recordloom-"))
    return context.getCheckpointDir()


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder: what it holds is fixed, and a lost executor loses none of it."""
    path = f"{shared_folder(rows.sparkSession)}/scratch-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
