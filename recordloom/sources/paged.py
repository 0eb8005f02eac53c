"""Paged remote lists as a data source: one list is read in one task, page after page by its cursor.

Fetching is a function given by the caller: it takes a query (with ``limit``, and ``cursor`` from the second page on) and
gives a page, a dictionary with the items and the next cursor. Lists are dealt to partitions; a task that is lost
reads its lists again, so a list is there once.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from recordloom.sources.pages import MOST_PAGES, PAGE_LIMIT

Fetch = Callable[[dict], dict | None]
#: list is the query as JSON; the last row of a list that ended early has no item but what went wrong.
SCHEMA = "list string, page int, nth int, item string, error string, truncated boolean"


@dataclass
class _Lists(InputPartition):
    queries: list[dict]


class _Reader(DataSourceReader):
    def __init__(self, fetch: Fetch, queries: Sequence[dict], items: str, limit: int, most_pages: int, partitions: int):
        self.fetch, self.queries, self.items, self.limit, self.most_pages = fetch, list(queries), items, min(max(limit, 1), PAGE_LIMIT), most_pages
        self.parts = max(1, min(partitions, len(self.queries)))

    def partitions(self) -> list[_Lists]:
        return [_Lists(self.queries[i :: self.parts]) for i in range(self.parts)]

    def read(self, partition: _Lists) -> Iterator[tuple]:
        for query in partition.queries:
            yield from self._list(query)

    def _list(self, query: dict) -> Iterator[tuple]:
        name, seen, cursor = json.dumps(query, sort_keys=True), set(), None
        for page in range(self.most_pages):
            try:
                answer = self.fetch(query | {"limit": self.limit} | ({"cursor": cursor} if cursor else {})) or {}
            except Exception as e:  # noqa: BLE001  what a server answers with is data here
                yield name, page, None, None, f"{type(e).__name__}: {e}"[:500], False
                return
            found = answer.get(self.items) or []
            for nth, item in enumerate(found):
                yield name, page, nth, json.dumps(item, separators=(",", ":"), ensure_ascii=False), None, False
            cursor = answer.get("cursor")
            if not found or not cursor or cursor in seen:
                return
            seen.add(cursor)
        yield name, self.most_pages, None, None, None, True


def paged_lists_of(lists: DataFrame, fetch: Fetch, items: str, query: str = "query", limit: int = PAGE_LIMIT, most_pages: int = MOST_PAGES) -> DataFrame:
    """``paged_lists`` for queries that are rows of a table, JSON texts in the column ``query``; they are read where they are. Nulls are no lists."""
    reader = _Reader(fetch, [], items, limit, most_pages, 1)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = reader._list(json.loads(text))
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return lists.where(F.col(query).isNotNull()).select(query).mapInArrow(read, SCHEMA)


def paged_lists(
    spark: SparkSession, fetch: Fetch, queries: Sequence[dict], items: str, limit: int = PAGE_LIMIT, most_pages: int = MOST_PAGES, partitions: int = 200
) -> DataFrame:
    """The items of each query's list (schema SCHEMA), in up to so many partitions.

    A list ends at an empty page or at a cursor that is missing, empty or repeated. Where it ends otherwise, its last row has no
    item: with ``error`` if a page could not be had (what came before stays), ``truncated`` if there were more than
    ``most_pages``. A null page is an empty one. Errors are rows and not failures, so look at them before the items are trusted.
    """
    name = f"paged-{uuid.uuid4().hex}"

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Reader(fetch, queries, items, limit, most_pages, partitions)

    spark.dataSource.register(Paged)
    return spark.read.format(name).load()


class RecordedPages:
    """A fetch function over recorded pages: JSON lines (list, cursor, page) in files under ``folder``/list=NAME, on any file system that Arrow opens.

    ``by`` is the field of the query that names the list; a list or a cursor that is not recorded is an error. With ``buckets``
    a list stands among others in ``folder``/bucket=N, where N is ``bucket_of_list``, and its lines have its name. The
    folder of the last list is held, so lists should be asked for bucket by bucket.
    """

    def __init__(self, folder: str, by: str, buckets: int | None = None):
        self.folder, self.by, self.buckets = folder, by, buckets
        self._held: tuple[str, dict] = "", {}

    def __call__(self, query: dict) -> dict:
        name, cursor = query[self.by], query.get("cursor")
        part = f"list={name}" if self.buckets is None else f"bucket={zlib.crc32(name.encode()) % self.buckets}"
        if self._held[0] != part:
            self._held = "", {}  # not two at once
            pages: dict = {}
            for line in _lines(f"{self.folder}/{part}"):
                row = json.loads(line)
                pages.setdefault((name if self.buckets is None else row["list"], row.get("cursor")), row["page"])
            self._held = part, pages
        page = self._held[1].get((name, cursor))
        if page is None:
            raise LookupError(f"no page of {name!r} at {cursor!r}")
        return json.loads(page)


def bucket_of_list(name: Column | str, buckets: int) -> Column:
    """The bucket that ``RecordedPages`` looks for a list in."""
    return (F.crc32(name) % buckets).cast("int")


def _lines(folder: str) -> Iterator[str]:
    """The lines of all files of a folder, files in the order of their names."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    for info in sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda i: i.path):
        if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
            with system.open_input_stream(info.path) as f:
                yield from f.read().decode().splitlines()
