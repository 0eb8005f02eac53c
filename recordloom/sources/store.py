"""A record store as thin tables on any file system that Spark can write.

* ``commits``: a row for each version. It is the last thing a batch writes, and what makes it visible; a version
  that is there is never written again, so of two writers one is refused and tries the next number.
* ``log``: the mutations of each batch, under a name of its own, sorted by bucket.
* ``base``: the folded records by bucket and collection. A compaction rewrites the buckets that changed, under a new
  name; the newest base commit says which name holds which bucket.
* ``feed``: the changes of each version. They follow from the commit and are written after it; where a writer is lost in
  between, the next one writes them.

A **bucket** is a share of the URIs by their hash. A batch reads the buckets it names, of the base
and of the few versions since, and writes its own rows. A batch is known by its **writer** and that one's number
for it, which have nothing to do with versions, so compactions, deletes and meta values may
come between any two batches of a stream. A writer's numbers only grow.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.errors import StorageError
from recordloom.operators import fold, typed
from recordloom.operators.metrics import observed
from recordloom.operators.query import RecordQuery
from recordloom.schema import FEED, MUTATIONS, RECORD_COLUMNS, RECORDS

CURSOR = "cursor"
#: The store's own meta value: the paths whose columns the base has.
_PATHS = "store:paths"
#: token: the name of the batch's rows in the log; writer, number: its identity; deletes: the name of deletes that stand in
#: for the log; base, buckets, writers and kept meta: the state that a base commit starts from.
COMMITS = (
    "version long, token string, writer string, number long, deletes string, meta map<string,string>, "
    "is_base boolean, names map<int,string>, writers map<string,long>"
)
BUCKETS = 32
#: Batches since the last base that make ``apply`` compact; so many small files are read by a batch at most.
COMPACT_AFTER = 64
#: Versions that a commit tries before it gives up against other writers.
TRIES = 20


def bucket_of(uri, buckets: int):
    return F.pmod(F.xxhash64(uri), F.lit(buckets)).cast("int")


def lookup(records: DataFrame, uri: str, include_deleted: bool = False) -> DataFrame:
    """The record of this URI, at most one row; a tombstone only with ``include_deleted``.

    The collection is cut out of the URI, so that of a table partitioned by it one part is read.
    """
    rows = records.where(F.col("uri") == uri)
    parts = uri.split("/")
    if len(parts) == 5:
        rows = rows.where(F.col("collection") == parts[3])
    return (rows if include_deleted else rows.where(~F.col("is_deleted"))).limit(1)


class _Log:
    """The commits since the newest base, and what they add up to. A few rows, by COMPACT_AFTER."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["version"])
        bases = [i for i, r in enumerate(rows) if r["is_base"]]
        self.base = rows[bases[-1]] if bases else None
        self.later = rows[bases[-1] + 1 :] if bases else rows
        self.version = rows[-1]["version"] if rows else 0
        self.names: dict[int, str] = dict(self.base["names"]) if bases else {}
        self.meta: dict[str, str] = dict(self.base["meta"]) if bases else {}
        self.writers: dict[str, int] = dict(self.base["writers"]) if bases else {}
        for r in self.later:
            self.meta |= dict(r["meta"] or {})
            if r["writer"] is not None:
                self.writers[r["writer"]] = max(r["number"], self.writers.get(r["writer"], r["number"]))

    def holds(self, writer: str | None, number: int) -> bool:
        return writer in self.writers and number <= self.writers[writer]

    @property
    def batches(self) -> dict[str, int]:
        """The version of each batch since the base, by its name in the log."""
        return {r["token"]: r["version"] for r in self.later if r["token"]}


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER, paths: Sequence[str] = ()):
        """``buckets`` is the same for all who open a store; a base of another number is an error.

        ``paths`` are JSON paths that the base keeps as typed columns (see ``typed``), for queries that filter or
        sort by them. With other paths than the base has they are made while reading, until the next compaction.
        """
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.compact_after, self.paths = buckets, compact_after, sorted(set(paths))

    # -- tables

    def _read(self, name: str, schema: str, parts: Iterable[str] | None = None) -> DataFrame:
        """A table of the store, empty if nothing is written yet; or these parts of it, all of which must be there."""
        root = f"{self.path}/{name}"
        paths = [f"{root}/{p}" for p in parts] if parts is not None else [root] if self._exists(root) else []
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _commits(self) -> _Log:
        bases = self._read("bases", "x int, version long").agg(F.max("version")).first()[0]
        rows = self._read("commits", COMMITS)
        return _Log((rows if bases is None else rows.where(F.col("version") >= bases)).collect())

    def versions(self) -> list[int]:
        """The versions that are whole."""
        return sorted(r["version"] for r in self._read("commits", COMMITS).select("version").collect())

    def _state(
        self, log: _Log, buckets: list[int] | None = None, only: Callable[[DataFrame], DataFrame] = lambda rows: rows, paths: Sequence[str] = ()
    ) -> DataFrame:
        """Records, tombstones included, of these buckets and of the rows that ``only`` lets through, with columns of ``paths``.

        Records that no batch since the base names are read as they stand, and filters on them reach their files;
        only the others are folded.
        """
        base = only(self._base(log, buckets, paths))
        if not log.batches:
            return base
        rows = self._read("log", f"{MUTATIONS}, bucket int, token string", [f"token={t}" for t in log.batches])
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        version = F.create_map(*[F.lit(x) for item in log.batches.items() for x in item])[F.col("token")]
        rows = only(rows.withColumn("seq", F.struct(version.cast("long").alias("batch"), "seq")).drop("bucket", "token"))
        named = rows.select("uri").distinct()
        folded = fold.fold(rows, base.select(*RECORD_COLUMNS).join(named, "uri", "left_semi"))
        return base.join(named, "uri", "left_anti").unionByName(typed.with_paths(folded, paths))

    def _base(self, log: _Log, buckets: list[int] | None = None, paths: Sequence[str] = ()) -> DataFrame:
        names = {b: n for b, n in log.names.items() if n and (buckets is None or b in buckets)}
        if any(b >= self.buckets for b in log.names):
            raise StorageError(f"the store has more than {self.buckets} buckets")
        kept = paths if log.meta.get(_PATHS) == json.dumps(self.paths) else ()
        rows = self._read("base", f"{RECORDS}{typed.schema(kept)}, name string, bucket int", [f"name={n}/bucket={b}" for b, n in names.items()])
        time = F.when(F.col("indexed_at") < 0, F.raise_error(F.concat(F.lit("a stored record has a negative time: "), "uri"))).otherwise(F.col("indexed_at"))
        rows = rows.withColumn("indexed_at", time.cast("long")).select(*RECORD_COLUMNS, *[c for p in kept for c in typed.names(p).values()])
        return rows if kept or not paths else typed.with_paths(rows, paths)

    def records(self, collection: str | None = None, typed_paths: bool = False) -> DataFrame:
        """All records, tombstones included; or those of a collection, of which alone the tables are read. With the columns of the store's paths, if asked for."""
        only = (lambda rows: rows) if collection is None else lambda rows: rows.where(F.col("collection") == collection)
        return self._state(self._commits(), None, only, self.paths if typed_paths else ())

    def changes(self, version: int | None = None) -> DataFrame:
        """The change feed of one version, the newest if not given."""
        log = self._commits()
        self._publish(log)
        version = log.version if version is None else version
        return self._read("feed", f"{FEED}, version long", [f"version={version}"]).drop("version")

    def subscribe(self) -> DataFrame:
        """A stream of the changes of the versions there are and of those to come, with ``version``; never of one that is not committed.

        Where a writer was lost while it wrote a feed, rows may come twice; ``follow`` gives each version once and whole.
        """
        self._publish(self._commits())
        return self.spark.readStream.schema(f"{FEED}, version long").option("basePath", f"{self.path}/feed").parquet(f"{self.path}/feed/*")

    def follow(self, checkpoint: str, each: Callable[[DataFrame, list[int]], None], drain: bool = True) -> StreamingQuery:
        """Calls ``each`` with the changes of whole versions, in their order, and their numbers; every version comes once.

        What is streamed is the commits; ``checkpoint`` remembers those that were seen. A call that fails is made again.
        """

        def some(rows: DataFrame, _: int) -> None:
            versions = sorted(r["version"] for r in rows.select("version").collect())  # a row for each commit
            self._publish(self._commits())
            each(self._read("feed", f"{FEED}, version long", [f"version={v}" for v in versions]), versions)

        stream = self.spark.readStream.schema(COMMITS).option("basePath", f"{self.path}/commits").parquet(f"{self.path}/commits/*")
        writer = stream.writeStream.foreachBatch(some).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if drain else writer).start()

    # -- commits

    def _commit(self, log: _Log, **values) -> tuple[int, _Log]:
        """The next version with these values, unless another writer has taken it; the version, or the commits that came in between."""
        known = {"token": None, "writer": None, "number": None, "deletes": None, "meta": {}, "is_base": False, "names": {}, "writers": {}} | values
        version = log.version + 1
        if version == 1:
            for name in ("bases", "fed"):
                self._mark(name, 0)
        columns = [c.split()[0] for c in COMMITS.split(", ")]
        row = self.spark.createDataFrame([tuple((known | {"version": version})[c] for c in columns)], COMMITS).drop("version").coalesce(1)
        try:
            row.write.mode("error").parquet(f"{self.path}/commits/version={version}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            newer = self._commits()
            if newer.version < version:
                raise StorageError(f"version {version} was begun and never finished; remove {self.path}/commits/version={version}") from e
            return 0, newer
        return version, log

    def _publish(self, log: _Log) -> None:
        """Writes the feeds that a lost writer left out. Since a feed is made of what came before it, the oldest comes first."""
        rows = [*([log.base] if log.base else []), *log.later]
        if rows:
            done = self._read("fed", "x int, version long").where(F.col("version") >= rows[0]["version"])
            done = {r["version"] for r in done.select("version").collect()}
            for r in rows:
                if r["version"] not in done:
                    self._feed(log, r)

    def _feed(self, log: _Log, commit) -> dict[str, int]:
        """The feed of a version, counted while it is written."""
        version, names = commit["version"], [f.split()[0] for f in FEED.split(", ")]
        if commit["token"]:
            rows = self._read("log", f"{MUTATIONS}, bucket int, token string", [f"token={commit['token']}"])
            before = _Log([r for r in [*([log.base] if log.base else []), *log.later] if r["version"] < version])
            buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
            uris = rows.select("uri").distinct()
            state = self._state(before, buckets, lambda x: x.join(uris, "uri", "left_semi"))
            changes = fold.feed(rows.drop("bucket", "token"), state)
        elif commit["deletes"]:
            changes = self._read("deletes", FEED, [commit["deletes"]])
        else:
            changes = self.spark.createDataFrame([], FEED)
        seen = Observation()
        counted = changes.select(*names).observe(seen, F.count_if(F.col("change") == "Upsert").alias("upserted"), F.count_if(F.col("change") == "Delete").alias("deleted"))
        counted.write.mode("overwrite").parquet(f"{self.path}/feed/version={version}")
        self._mark("fed", version)
        return observed(seen, upserted=0, deleted=0)

    def _mark(self, name: str, version: int) -> None:
        self.spark.createDataFrame([(1,)], "x int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")

    def _rebase(self, records: Callable[[_Log, list[int]], DataFrame], touched: list[int] | None, deletes: Callable[[_Log], DataFrame] | None = None) -> int:
        """A version whose base has these records in the buckets touched (those with log rows, if not given), and the others as they are."""
        log = self._commits()
        for _ in range(TRIES):
            self._publish(log)
            buckets = sorted({*(touched or []), *self._logged(log)})
            if log.meta.get(_PATHS, "[]") != json.dumps(self.paths):  # the base gets other columns
                buckets = list(range(self.buckets))
            name, fed = uuid.uuid4().hex, uuid.uuid4().hex if deletes else None
            if deletes:
                deletes(log).write.parquet(f"{self.path}/deletes/{fed}")
            seen = Observation()
            rows = typed.with_paths(records(log, buckets), self.paths).withColumn("bucket", bucket_of("uri", self.buckets)).observe(seen, F.collect_set("bucket").alias("held"))
            rows.repartition("bucket").sortWithinPartitions("bucket", "collection", "indexed_at").write.partitionBy("bucket", "collection").parquet(f"{self.path}/base/name={name}")
            held = set(observed(seen, held=[])["held"])
            names = log.names | {b: name if b in held else "" for b in buckets}
            version, log = self._commit(log, deletes=fed, meta=log.meta | {_PATHS: json.dumps(self.paths)}, is_base=True, names=names, writers=log.writers)
            if version:
                self._mark("bases", version)
                after = self._commits()
                self._feed(after, after.base)
                return version
        raise StorageError("other writers kept taking the next version")

    def _logged(self, log: _Log) -> list[int]:
        rows = self._read("log", "bucket int, token string", [f"token={t}" for t in log.batches])
        return [r["bucket"] for r in rows.select("bucket").distinct().collect()]

    def compact(self) -> None:
        """Folds the log into the base. Buckets that no batch named since the last time are left as they are."""
        self._rebase(self._state, None)

    # -- mutations

    def apply(
        self, mutations: DataFrame, cursor: int | Callable[[], int | None] | None = None, writer: str | None = None, number: int | None = None
    ) -> dict[str, int]:
        """One atomic batch; mutations out of range are skipped. A batch that its writer has numbered is applied once.

        ``cursor`` may be a function, which is asked when the mutations have been read.

        A number at or below the writer's last one is a batch that is run again: it is left alone, and its counts are zero.
        The plan of ``mutations`` runs once.
        """
        log = self._commits()
        done = lambda log: number is not None and log.holds(writer, number)
        if done(log):
            return {"upserted": 0, "deleted": 0, "skipped": 0}
        self._publish(log)
        token, seen = uuid.uuid4().hex, Observation()
        fine = F.coalesce((F.col("indexed_at") >= 0) & (F.col("indexed_at") <= fold.LATEST), F.lit(False))
        counted = mutations.observe(seen, F.count_if(~fine).alias("skipped"))
        rows = fold.in_range(counted).where("uri is not null").select(*[f.split()[0] for f in MUTATIONS.split(", ")], bucket_of("uri", self.buckets).alias("bucket"))
        rows.sortWithinPartitions("bucket").write.parquet(f"{self.path}/log/token={token}")
        cursor = cursor() if callable(cursor) else cursor
        for _ in range(TRIES):
            meta = {} if cursor is None else {CURSOR: str(max(cursor, _number(log.meta.get(CURSOR)) or 0))}
            version, log = self._commit(log, token=token, writer=writer, number=number, meta=meta)
            if version:
                break
            if done(log):
                return {"upserted": 0, "deleted": 0, "skipped": 0}
        else:
            raise StorageError("other writers kept taking the next version")
        after = self._commits()
        counts = self._feed(after, next(r for r in after.later if r["version"] == version))
        if len(after.batches) >= self.compact_after:
            self.compact()
        return {"upserted": counts["upserted"], "deleted": counts["deleted"], "skipped": observed(seen, skipped=0)["skipped"]}

    def applied(self, writer: str, number: int) -> bool:
        """Whether the store holds this batch of this writer."""
        return self._commits().holds(writer, number)

    def upsert(self, mutations: DataFrame) -> dict[str, int]:
        """A batch of upserts that is refused as a whole if any time is out of range."""
        return self.apply(fold.validated(mutations))

    def _buckets_of(self, uris: DataFrame) -> list[int]:
        return [r[0] for r in uris.select(bucket_of("uri", self.buckets)).distinct().collect()]

    def soft_delete_unversioned(self, uris: DataFrame) -> None:
        """Marks these URIs deleted without a time of their own; this rewrites their buckets."""
        touched, keys = self._buckets_of(uris), uris.select("uri").distinct()
        hit = lambda log: self._state(log, touched).where("not is_deleted").join(keys, "uri", "left_semi")
        self._rebase(lambda log, buckets: fold.soft_deleted_unversioned(self._state(log, buckets), uris), touched, lambda log: _deletes(hit(log)))

    def hard_delete(self, uris: DataFrame) -> int:
        """Removes the records of these URIs and says how many there were; this rewrites their buckets."""
        touched = self._buckets_of(uris)
        version = self._rebase(
            lambda log, buckets: fold.hard_deleted(self._state(log, buckets), uris)[0], touched, lambda log: _deletes(fold.hard_deleted(self._state(log, touched), uris)[1])
        )
        return self.changes(version).count()

    # -- reads

    def get(self, uri: str, include_deleted: bool = False) -> DataFrame:
        """At most one row; one bucket is read."""
        bucket = self.spark.range(1).select(bucket_of(F.lit(uri), self.buckets)).first()[0]
        return lookup(self._state(self._commits(), [bucket], lambda rows: rows.where(F.col("uri") == uri)), uri, include_deleted)

    def query(self) -> RecordQuery:
        return RecordQuery(lambda collection: self.records(collection, typed_paths=True))

    # -- meta values

    def meta(self) -> dict[str, str]:
        """The newest value of each key."""
        return {k: v for k, v in self._commits().meta.items() if v is not None and k != _PATHS}

    def _set(self, values: Callable[[_Log], dict[str, str | None] | None]) -> bool:
        log = self._commits()
        for _ in range(TRIES):
            new = values(log)
            if new is None:
                return False
            version, log = self._commit(log, meta=new)
            if version:
                return True
        raise StorageError("other writers kept taking the next version")

    def set_meta(self, key: str, value: str) -> None:
        self._set(lambda log: {key: value})

    def cursor(self) -> int | None:
        return _number(self._commits().meta.get(CURSOR))

    def set_cursor(self, value: int) -> bool:
        """Cursors only move on, and zero is none; says whether it moved."""
        return self._set(lambda log: {CURSOR: str(value)} if value > (_number(log.meta.get(CURSOR)) or 0) else None)

    def force_cursor(self, value: int) -> None:
        """Sets the cursor wherever it stood, for a deliberate replay; zero takes it away."""
        self._set(lambda log: {CURSOR: str(value) if value else None})


def _number(value: str | None) -> int | None:
    if value is None:
        return None
    try:
        return int(value)
    except ValueError as e:
        raise StorageError(f"the stored cursor {value!r} is no number") from e


def _deletes(rows: DataFrame) -> DataFrame:
    """Records as deletes of the change feed."""
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return rows.select(none("seq", "long"), F.lit("Delete").alias("change"), "uri", "did", "collection", "rkey", none("cid", "string"), none("record_json", "string"), none("indexed_at", "long"))
