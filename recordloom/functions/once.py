"""Columns that are computed once for a row, however often they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with ``value`` as column ``name``.

    The value is exploded from an array of one element: the optimizer copies the expression of a plain
    column into every filter and every later expression that uses it, but none over an explode.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is computed once, as a column: the value is bound like an element of an array."""
    return F.get(F.transform(F.array(value), result), 0)
