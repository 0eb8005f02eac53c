"""Queries over one collection as lazy DataFrames.

``RecordQuery`` collects predicates, order and paging and gives a plan; nothing runs until an action
does. Equality on collection and DID reaches the Parquet scan; order with a limit becomes a top-k.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.errors import IndexError_
from recordloom.functions.jsonpath import TypedKey, ascii_lower, compare, like_regex, literal_of, normalise_path, quoted_path
from recordloom.functions.once import once
from recordloom.operators import typed
from recordloom.operators.numbering import numbered
from recordloom.schema import RECORD_COLUMNS

COMPARISONS = {"eq": "=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
SORTABLE = ("indexed_at", "uri", "did", "collection", "rkey", "cid")
#: An offset and a limit of so many rows together are a top-k, whose rows meet in one task; others go by row numbers.
TOP = 1 << 16


def predicate(document: Column, path: str, op: str, value) -> Column:
    """A condition on a JSON path: eq, ne, gt, gte, lt, lte, contains or like. Never null.

    ``eq None`` means null or missing; ``ne`` also holds where the path is null or missing; other
    comparisons never hold there. Every number is less than every text. ``contains`` and ``like``
    ignore the case of A-Z only; ``%`` and ``_`` are wildcards in ``like``.
    """
    return condition(TypedKey.of(document, path), op, value)


def condition(key: TypedKey, op: str, value) -> Column:
    """``predicate`` on a key."""
    if op in ("eq", "ne") and value is None:
        return key.cls.isNull() if op == "eq" else key.cls.isNotNull()
    if op == "ne":
        return ~compare(key, "=", value)
    if value is None and op in (*COMPARISONS, "contains", "like"):
        return F.lit(False)
    if op in COMPARISONS:
        return compare(key, COMPARISONS[op], value)
    if op not in ("contains", "like"):
        raise IndexError_(f"unknown operator {op!r}")
    text = ascii_lower(key.text)
    if op == "contains" and isinstance(value, str):
        found = F.contains(text, ascii_lower(F.lit(value)))
    else:
        pattern = str(literal_of(value)[1])
        found = text.rlike(like_regex(f"%{pattern}%" if op == "contains" else pattern))
    return F.coalesce(key.cls.isNotNull() & found, F.lit(False))


@dataclass(frozen=True)
class RecordQuery:
    #: The records, or what gives those of a collection.
    records: DataFrame | Callable[[str], DataFrame]
    collection_name: str | None = None
    did_name: str | None = None
    clauses: tuple = ()
    keys: tuple = ()
    most: int | None = None
    skip: int | None = None
    deleted: bool = False
    last_uri: str | None = None

    def collection(self, name: str) -> RecordQuery:
        return replace(self, collection_name=name)

    def did(self, name: str) -> RecordQuery:
        return replace(self, did_name=name)

    def where_json(self, path: str, op: str, value) -> RecordQuery:
        return replace(self, clauses=(*self.clauses, (path, op, value)))

    def order_by(self, column: str, descending: bool = False) -> RecordQuery:
        """A record column, or else a JSON path."""
        return replace(self, keys=(*self.keys, (column, descending)))

    def limit(self, n: int) -> RecordQuery:
        return replace(self, most=n)

    def offset(self, n: int) -> RecordQuery:
        return replace(self, skip=n)

    def include_deleted(self, yes: bool = True) -> RecordQuery:
        return replace(self, deleted=yes)

    def _keyed(self, rows: DataFrame) -> tuple[DataFrame, Callable[[str], TypedKey]]:
        """``rows`` with the value at each JSON path that is asked for, all out of one parse, and the keys over them.

        Paths that ``rows`` has typed columns of are not looked for in the document.
        """
        paths = {path: quoted_path(path) for path in [p for p, _, _ in self.clauses] + [c for c, _ in self.keys if c not in SORTABLE]}
        stored = {path: key for path in paths if (key := typed.stored_key(rows, path)) is not None}
        bound = typed.bounds(typed.bound(stored[path], op, value) for path, op, value in self.clauses if path in stored)
        if bound is not None:
            rows = rows.where(bound)
        found = list(dict.fromkeys(p for path, p in paths.items() if p is not None and path not in stored))
        if not found:
            return rows, lambda path: stored.get(path) or TypedKey.nothing()
        document = F.col("record_json")
        rows = once(rows, "__v", F.try_parse_json(document))
        rows = once(rows, "__items", F.struct(*[F.try_variant_get("__v", p, "variant").alias(f"i{n}") for n, p in enumerate(found)]))
        rows = once(rows, "__kinds", F.struct(*[F.schema_of_variant(F.col(f"__items.i{n}")).alias(f"k{n}") for n in range(len(found))]))

        def key(path: str) -> TypedKey:
            if path in stored:
                return stored[path]
            if paths[path] is None:
                return TypedKey.nothing()
            n = found.index(paths[path])
            return TypedKey.over(F.col(f"__items.i{n}"), document, paths[path], F.col(f"__kinds.k{n}"))

        return rows, key

    def _order(self, key: Callable[[str], TypedKey]) -> list[Column]:
        keys: list[Column] = []
        for column, descending in self.keys:
            if column in SORTABLE:
                keys.append(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first())
            else:
                keys += key(column).order(descending)
        return keys

    def _rows(self) -> tuple[DataFrame, list[Column]]:
        """The rows of the query and the keys of their order."""
        name = (self.collection_name or "").strip()
        if not name:
            raise IndexError_("a query needs a collection")
        for path, _, _ in self.clauses:
            normalise_path(path)
        rows = (self.records if isinstance(self.records, DataFrame) else self.records(name)).where(F.col("collection") == name)
        if not self.deleted:
            rows = rows.where(~F.col("is_deleted"))
        if self.did_name is not None:
            rows = rows.where(F.col("did") == self.did_name.strip())
        if self.last_uri is not None:
            rows = rows.where(F.col("uri") > self.last_uri)
        rows, key = self._keyed(rows)
        for path, op, value in self.clauses:
            rows = rows.where(condition(key(path), op, value))
        return rows, self._order(key)

    def after(self, uri: str) -> RecordQuery:
        """Only rows of a larger URI: the next page of rows in the order of their URIs costs no more than the first."""
        return replace(self, last_uri=uri)

    def pages(self, size: int) -> DataFrame:
        """All rows with ``page``, from 0 on: the pages of ``size`` rows that a paging loop to exhaustion would read.

        Rows are numbered over all tasks (see ``numbering``), which runs when this is called. With an
        offset or a limit the pages are cut from the whole order, and only their rows within it are there.
        """
        if size < 1:
            raise IndexError_("a page holds at least one row")
        rows, keys = self._rows()
        rows = _within(numbered(rows, [*keys, F.col("uri")], RECORD_COLUMNS), self.skip, self.most)
        return rows.select(*RECORD_COLUMNS, F.floor(F.col("number") / size).cast("long").alias("page"))

    def page(self, number: int, size: int) -> DataFrame:
        """One page, in order: a top-k if it is near the beginning."""
        return replace(self, skip=(self.skip or 0) + number * size, most=max(0, size if self.most is None else min(size, self.most - number * size))).dataframe()

    def cursors(self, size: int) -> DataFrame:
        """A row for each page: page, first_uri, last_uri and rows, from which every page can be read by itself."""
        by = lambda f: f("uri", F.struct("page", "number"))
        rows, keys = self._rows()
        rows = _within(numbered(rows, [*keys, F.col("uri")], ["uri"]), self.skip, self.most)
        rows = rows.withColumn("page", F.floor(F.col("number") / size).cast("long"))
        return rows.groupBy("page").agg(by(F.min_by).alias("first_uri"), by(F.max_by).alias("last_uri"), F.count("*").alias("rows"))

    def dataframe(self) -> DataFrame:
        """The plan. Paging and ties are made repeatable by the URI as the last key.

        An offset and a limit of up to TOP rows together are a plan that runs later; beyond that, or with
        an offset alone, rows are numbered over all tasks at once, and what is returned reads them.
        """
        rows, keys = self._rows()
        order, skip, most = [*keys, F.col("uri")], self.skip or 0, self.most
        if most is not None and (most == 0 or skip + most <= TOP):
            return rows.orderBy(*order).offset(skip).limit(most).select(*RECORD_COLUMNS)
        if skip or most is not None:
            return _within(numbered(rows, order, RECORD_COLUMNS), skip, most).orderBy("number").select(*RECORD_COLUMNS)
        return (rows.orderBy(*order) if keys else rows).select(*RECORD_COLUMNS)


def _within(rows: DataFrame, skip: int | None, most: int | None) -> DataFrame:
    """Numbered rows after the first ``skip``, at most ``most``: any numbers, though Spark's are of 31 bits."""
    skip = skip or 0
    if skip:
        rows = rows.where(F.col("number") >= skip)
    return rows if most is None else rows.where(F.col("number") < skip + most)
