"""Links in text with their UTF-8 byte offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may not end a link, and brackets that end one only if they are unbalanced. A
#: match is printable ASCII, so that no other character can stand at its end.
TRAILING = ".,;:!?\"'`><*~"
BRACKETS = {")": "(", "]": "[", "}": "{"}
_LINK = re.compile(rb"(?<![0-9A-Za-z_])[hH][tT][tT][pP][sS]?://[\x21-\x7E]+")
_HOST = re.compile(r"[^\s/?#\\@<>^|%]+\Z")


def trimmed(url: str) -> str:
    while url:
        last = url[-1]
        if last not in TRAILING and not (last in BRACKETS and url.count(last) > url.count(BRACKETS[last])):
            break
        url = url[:-1]
    return url


def _is_url(url: str) -> bool:
    try:
        parts = urlsplit(url)
        parts.port  # noqa: B018  raises if it is no port
    except ValueError:
        return False
    return parts.scheme in ("http", "https") and bool(parts.hostname) and _HOST.match(parts.hostname) is not None


def links(text: str | None) -> list[dict]:
    """(byteStart, byteEnd, uri) of each link of a text, in order."""
    found = []
    for m in _LINK.finditer((text or "").encode("utf-8")):
        url = trimmed(m[0].decode("ascii"))
        if _is_url(url):
            found.append({"byteStart": m.start(), "byteEnd": m.start() + len(url), "uri": url})
    return found


def link_facets(text: Column) -> Column:
    """Array of (byteStart, byteEnd, uri); empty for null. Of texts without ``://`` nothing is sent to Python."""
    kind = pa.list_(pa.struct([("byteStart", pa.int32()), ("byteEnd", pa.int32()), ("uri", pa.string())]))

    @F.arrow_udf("array<struct<byteStart: int, byteEnd: int, uri: string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([links(t) if t and "://" in t else [] for t in batch.to_pylist()], kind)

    none = F.array().cast("array<struct<byteStart: int, byteEnd: int, uri: string>>")
    return F.when(F.coalesce(F.contains(text, F.lit("://")), F.lit(False)), found(F.when(F.contains(text, F.lit("://")), text))).otherwise(none)


def message_payload(text: Column) -> Column:
    """Struct (text, facets); facets are null where there is no link."""
    facets = link_facets(text)
    return F.struct(text.alias("text"), F.when(F.size(facets) > 0, facets).alias("facets"))
