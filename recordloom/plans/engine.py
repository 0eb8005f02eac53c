"""The facade: one object with a store, queries and ingestion."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from recordloom.errors import ConfigError
from recordloom.operators.query import RecordQuery
from recordloom.sources.scratch import shared_folder
from recordloom.sources.store import RecordStore
from recordloom.streaming import ingest


@dataclass(frozen=True)
class Config:
    """Where records are kept (a path, else for the session only, else nowhere) and which of the stream is wanted."""

    storage_path: str | None = None
    in_memory: bool = False
    checkpoint_path: str | None = None
    collections: tuple[str, ...] = ()
    dids: tuple[str, ...] = ()
    files_per_batch: int = 100
    #: Count as records applied one by one do.
    single: bool = False
    #: Where rejected frames are written, if anywhere.
    rejected_path: str | None = None

    def with_storage(self, path: str) -> Config:
        return replace(self, storage_path=path)

    def with_memory(self) -> Config:
        """A store that lasts as long as the session, in a folder of its own beside the checkpoints."""
        return replace(self, in_memory=True)

    def with_wanted(self, collections: tuple[str, ...] = (), dids: tuple[str, ...] = ()) -> Config:
        return replace(self, collections=collections, dids=dids)


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


class Engine:
    def __init__(self, spark: SparkSession, config: Config, store: RecordStore | None = None):
        """A store that is given comes before a storage path, and that before a store in memory."""
        self.spark, self.config = spark, config
        path = config.storage_path or (_session_folder(spark) if config.in_memory and store is None else None)
        self._store = store or (RecordStore(spark, path) if path else None)

    @property
    def store(self) -> RecordStore:
        if self._store is None:
            raise ConfigError("no store is configured")
        return self._store

    def query(self) -> RecordQuery:
        return self.store.query()

    def collection(self, name: str) -> RecordQuery:
        return self.query().collection(name)

    def subscribe(self) -> DataFrame:
        """A stream of the changes of the store."""
        return self.store.subscribe()

    def sql(self, text: str, **args) -> DataFrame:
        """Spark SQL over the view ``records``; values are bound, not pasted."""
        self.store.records().createOrReplaceTempView("records")
        return self.spark.sql(text, args=args)

    def ingest(self, source: DataFrame, drain: bool = True):
        if not self.config.checkpoint_path:
            raise ConfigError("no checkpoint is configured")
        return ingest.start(source, self.store, self.config.checkpoint_path, self.config.collections, self.config.dids, drain=drain, single=self.config.single, rejected_path=self.config.rejected_path)
