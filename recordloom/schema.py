"""Schemas of records, mutations and the change feed."""

from __future__ import annotations

RECORD_COLUMNS = ["uri", "cid", "did", "collection", "rkey", "record_json", "indexed_at", "is_deleted"]
RECORDS = "uri string, cid string, did string, collection string, rkey string, record_json string, indexed_at long, is_deleted boolean"
#: op is U (upsert) or D (delete); seq is the order of arrival.
MUTATIONS = "seq long, op string, uri string, cid string, did string, collection string, rkey string, record_json string, indexed_at long"
FEED = "seq long, change string, uri string, did string, collection string, rkey string, cid string, record_json string, indexed_at long"
