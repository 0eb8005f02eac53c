"""JSON paths kept as typed columns, so that predicates on them are looked up in file statistics and no document is parsed.

A path has four columns: its class, decimal, double and text (see ``jsonpath.TypedKey``). ``RecordQuery`` uses
them where they are, and puts a plain bound before the exact condition: a comparison of one column with a literal that
holds wherever the condition does, which is what a Parquet scan takes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.jsonpath import TypedKey, literal_of, normalise_path, quoted_path
from recordloom.functions.once import once

PARTS = {"cls": "int", "decimal": "decimal(38,18)", "double": "double", "text": "string"}


def names(path: str) -> dict[str, str]:
    """The columns of a path, by part."""
    mark = hashlib.sha256(normalise_path(path).encode()).hexdigest()[:16]
    return {part: f"path_{mark}_{part}" for part in PARTS}


def schema(paths: Iterable[str]) -> str:
    """The columns of these paths as DDL, beginning with a comma."""
    return "".join(f", {name} {PARTS[part]}" for path in paths for part, name in names(path).items())


def with_paths(records: DataFrame, paths: Sequence[str]) -> DataFrame:
    """``records`` with the columns of these paths, all out of one parse of ``record_json``; those that are there are made anew."""
    where = {path: quoted_path(path) for path in paths}
    rows = records.drop(*[n for path in paths for n in names(path).values()])
    real = [path for path in where if where[path] is not None]
    if real:
        rows = once(rows, "__v", F.try_parse_json("record_json"))
        rows = once(rows, "__items", F.struct(*[F.try_variant_get("__v", where[p], "variant").alias(f"i{n}") for n, p in enumerate(real)]))
    for path in paths:
        key = TypedKey.over(F.col(f"__items.i{real.index(path)}"), F.col("record_json"), where[path]) if path in real else TypedKey.nothing()
        rows = rows.withColumns({name: getattr(key, part).cast(PARTS[part]) for part, name in names(path).items()})
    return rows.drop("__v", "__items")


def stored_key(rows: DataFrame, path: str) -> TypedKey | None:
    """The key over the columns of a path, if ``rows`` has them."""
    columns = names(path)
    return TypedKey(**{part: F.col(name) for part, name in columns.items()}) if set(columns.values()) <= set(rows.columns) else None


def bound(key: TypedKey, op: str, value) -> Column | None:
    """A condition on one column that holds wherever ``op`` does; None if there is none."""
    cls, literal = literal_of(value)
    if cls is None:
        return {"eq": key.cls.isNull(), "ne": key.cls.isNotNull()}.get(op)
    if op in ("contains", "like"):
        return key.cls.isNotNull()
    if op not in ("eq", "gt", "gte", "lt", "lte"):
        return None
    if cls == 1:
        # a decimal is rounded to 18 places and a double to 53 bits, so equal numbers may be a little apart
        apart = 1e-17 + abs(float(literal)) * 1e-14
        over, under = key.double >= float(literal) - apart, key.double <= float(literal) + apart
    else:
        over, under = key.text >= literal, key.text <= literal
    if op == "eq":
        return over & under if cls == 1 else key.text == literal
    if op in ("gt", "gte"):
        return over | (key.cls > 1) if cls == 1 else over
    return under if cls == 1 else under | (key.cls < 2)


def bounds(conditions: Iterable[Column | None]) -> Column | None:
    found = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, found) if found else None
