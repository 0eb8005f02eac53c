"""Paged remote lists and subscription addresses. Fetching is a function given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, quote_plus, urlsplit, urlunsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed limits.
MOST_PAGES, PAGE_LIMIT, TYPEAHEAD_LIMIT = 100, 100, 25


def paginate(fetch: Callable[[dict], dict | None], query: dict, limit: int, items: str) -> Iterator[dict]:
    """Items page by page until an error, an empty page, or a missing, empty or repeated cursor; at most 100 pages."""
    seen: set[str] = set()
    cursor = None
    for _ in range(MOST_PAGES):
        try:
            page = fetch(query | {"limit": min(max(limit, 1), PAGE_LIMIT)} | ({"cursor": cursor} if cursor else {}))
        except Exception:  # noqa: BLE001  what came so far is the result
            return
        found = (page or {}).get(items) or []
        yield from found
        cursor = (page or {}).get("cursor")
        if not found or not cursor or cursor in seen:
            return
        seen.add(cursor)


def follows(pages: DataFrame) -> DataFrame:
    """DIDs of pages with an array ``follows`` of structs."""
    return pages.select(F.explode("follows").alias("f")).select(F.col("f.did").alias("did"))


def followers(pages: DataFrame) -> DataFrame:
    """DIDs of pages with an array ``followers`` of structs."""
    return pages.select(F.explode("followers").alias("f")).select(F.col("f.did").alias("did"))


def profiles(pages: DataFrame) -> DataFrame:
    """(did, handle, displayName) of answers that name a DID; fields that are missing are null."""
    known = set(pages.columns)
    field = lambda name: (F.col(name) if name in known else F.lit(None)).cast("string").alias(name)
    return pages.select(field("did"), field("handle"), field("displayName")).where("did is not null")


def posts(pages: DataFrame) -> DataFrame:
    """(uri, cid, value) of answers for single records; those without a URI are dropped."""
    return pages.select("uri", "cid", "value").where("uri is not null")


def typeahead_limit(n: int) -> int:
    return min(max(n, 1), TYPEAHEAD_LIMIT)


def follow_records(pages: DataFrame) -> DataFrame:
    """(rkey, subject) of pages with an array ``records`` of (uri, value); empty ones are dropped."""
    rows = pages.select(F.explode("records").alias("r"))
    rows = rows.select(F.element_at(F.split("r.uri", "/"), -1).alias("rkey"), F.col("r.value.subject").alias("subject"))
    return rows.where("rkey <> '' and subject <> ''")


def subscription_url(base: str, collections: list[str] = (), dids: list[str] = (), cursor: int | None = None) -> str:
    """``base`` with the wanted collections, DIDs and cursor, each once; the scheme defaults to wss."""
    parts = urlsplit(base if "://" in base else f"wss://{base}")
    present = parse_qsl(parts.query, keep_blank_values=True)
    wanted = [("wantedCollections", c) for c in collections] + [("wantedDids", d) for d in dids]
    if cursor and cursor > 0 and not any(k == "cursor" for k, _ in present):
        wanted.append(("cursor", str(cursor)))
    added = [f"{k}={quote_plus(v, safe=':')}" for k, v in dict.fromkeys(wanted) if (k, v) not in present]
    query = "&".join([*([parts.query] if parts.query else []), *added])
    return urlunsplit((parts.scheme, parts.netloc, parts.path or "/", query, parts.fragment))
