"""JSON paths and typed keys: how a value inside a JSON column compares and sorts.

A value has a class (1 for numbers and booleans, 2 for text and nested values, null for null or
missing), a decimal and a double for class 1, and a text. Numbers sort before text.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.errors import IndexError_

_ALLOWED = re.compile(r"[A-Za-z0-9_.\-\[\]]*\Z")
_STEP = re.compile(r"\.([^.\[\]]*)|\[(\d+)\]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise_path(path: str) -> str:
    """``a.b`` -> ``$.a.b``, ``[0]`` -> ``$[0]``; paths with other characters are refused."""
    path = path.strip()
    if not path:
        raise IndexError_("empty JSON path")
    if not path.startswith("$"):
        path = f"${path}" if path.startswith("[") else f"$.{path}"
    rest = path[1:]
    if rest and rest[0] not in ".[":
        raise IndexError_(f"JSON path {path!r} must go on with '.' or '['")
    if not _ALLOWED.match(rest):
        raise IndexError_(f"JSON path {path!r} has characters that are not allowed")
    if re.search(r"\[(?!\d+\])", rest) or rest.endswith(".") or re.sub(r"\[\d+\]", "", rest).count("]"):
        raise IndexError_(f"JSON path {path!r} is malformed")
    return path


def quoted_path(path: str) -> str | None:
    """The path with every name in brackets, as Spark's functions take it; None if it can match nothing."""
    steps = _STEP.findall(normalise_path(path)[1:])
    if any(name == "" and index == "" for name, index in steps):
        return None
    return "$" + "".join(f"[{index}]" if index else f"['{name}']" for name, index in steps)


@dataclass
class TypedKey:
    cls: Column
    decimal: Column
    double: Column
    text: Column

    @classmethod
    def of(cls, document: Column, path: str) -> TypedKey:
        where = quoted_path(path)
        if where is None:
            return cls.nothing()
        return cls.over(F.try_variant_get(F.try_parse_json(document), where, "variant"), document, where)

    @classmethod
    def nothing(cls) -> TypedKey:
        none = F.lit(None)
        return cls(none.cast("int"), none.cast("decimal(38,18)"), none.cast("double"), none.cast("string"))

    @classmethod
    def over(cls, item: Column, document: Column, where: str, kind: Column | None = None) -> TypedKey:
        """Of a variant that was taken from ``where`` in the document; the document itself is read again only for
        the text of numbers and nested values. ``kind``: the type of the variant, if it is known."""
        kind = F.schema_of_variant(item) if kind is None else kind
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        truth = kind == "BOOLEAN"
        class_ = F.when(kind.isNull() | (kind == "VOID"), None).when(number | truth, 1).otherwise(2)
        string = F.try_variant_get(item, "$", "string")
        text = F.when(kind == "STRING", string).when(truth, F.when(string == "true", "1").otherwise("0")).otherwise(F.get_json_object(document, where))
        as_ = lambda t: F.when(truth, F.when(string == "true", 1).otherwise(0).cast(t)).when(number, F.try_variant_get(item, "$", t))
        return cls(class_, as_("decimal(38,18)"), as_("double"), text)

    def order(self, descending: bool) -> list[Column]:
        """Null first when rising and last when falling; numbers before text."""
        keys = [self.cls, self.double, self.decimal, F.when(self.cls == 2, self.text)]
        return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def literal_of(value) -> tuple[int | None, object]:
    """(class, value) of a Python value: booleans are 1 and 0, integers beyond 64 bits are text."""
    if value is None:
        return None, None
    if isinstance(value, bool):
        return 1, int(value)
    if isinstance(value, int):
        return (1, value) if -(1 << 63) <= value < 1 << 63 else (2, str(value))
    if isinstance(value, float):
        return 1, value
    if isinstance(value, str):
        return 2, value
    return 2, json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def compare(key: TypedKey, op: str, value) -> Column:
    """One of = > >= < <= against a value that is not null; never null."""
    cls, literal = literal_of(value)
    if cls == 1:
        exact = F.lit(Decimal(str(literal))) if abs(literal) < 1e19 else None
        apply = lambda side, other: {"=": side == other, ">": side > other, ">=": side >= other, "<": side < other, "<=": side <= other}[op]
        by_double = apply(key.double, F.lit(float(literal)))
        same = F.when(key.decimal.isNotNull(), apply(key.decimal, exact)).otherwise(by_double) if exact is not None else by_double
    else:
        side, other = key.text, F.lit(literal)
        same = {"=": side == other, ">": side > other, ">=": side >= other, "<": side < other, "<=": side <= other}[op]
    found = (key.cls == cls) & same
    if op in (">", ">="):
        found = found | (key.cls > cls)
    elif op in ("<", "<="):
        found = found | (key.cls < cls)
    return F.coalesce(found, F.lit(False))


def like_regex(pattern: str) -> str:
    """A pattern with % and _ as a regular expression; a backslash is an ordinary character."""
    low = pattern.translate(str.maketrans(UPPER, LOWER))
    return r"(?s)\A" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in low) + r"\z"
