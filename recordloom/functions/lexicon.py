"""Functions over JSON documents of records: mentions, quotes, images, labels, messages, constructors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.identifiers import trimmed
from recordloom.functions.once import let

#: Fixed values of the protocol.
MENTION = "app.bsky.richtext.facet#mention"
EMBED_RECORD = "app.bsky.embed.record"
EMBED_WITH_MEDIA = "app.bsky.embed.recordWithMedia"
EMBED_IMAGES = "app.bsky.embed.images"
EMBED_GALLERY = "app.bsky.embed.gallery"
MODERATION_LIST = "app.bsky.graph.defs#modlist"
DELETED_MESSAGE = "#deletedMessageView"
#: Self-labels that mark adult content: fixed values.
ADULT_LABELS = ("porn", "sexual", "nudity", "graphic-media", "graphic", "adult", "nsfw", "suggestive", "gore", "corpse")

_FACETS = "array<struct<features: array<struct<`$type`: string, did: string, uri: string, tag: string>>>>"


def mentioned_dids(facets_json: Column) -> Column:
    """DIDs of all mention features in order, repeats kept; empty for null or malformed facets."""
    facets = F.from_json(facets_json, _FACETS)
    features = F.flatten(F.transform(facets, lambda f: F.coalesce(f["features"], F.array().cast("array<struct<`$type`: string, did: string, uri: string, tag: string>>"))))
    dids = F.transform(F.filter(features, lambda x: x["$type"] == MENTION), lambda x: x["did"])
    return F.coalesce(dids, F.array().cast("array<string>"))


def mentions(facets_json: Column, did: str) -> Column:
    return F.array_contains(mentioned_dids(facets_json), did)


def quote(embed_json: Column, field: str = "uri") -> Column:
    """URI (or cid) of the quoted record, null if the embed quotes nothing."""
    kind = F.get_json_object(embed_json, "$['$type']")
    return F.when(kind == EMBED_RECORD, F.get_json_object(embed_json, f"$.record.{field}")).when(
        kind == EMBED_WITH_MEDIA, F.get_json_object(embed_json, f"$.record.record.{field}")
    )


def is_quote(embed_json: Column) -> Column:
    return F.coalesce(F.get_json_object(embed_json, "$['$type']").isin(EMBED_RECORD, EMBED_WITH_MEDIA), F.lit(False))


_NO_IMAGES = "array<struct<cid: string, alt: string>>"


def _string(value: Column, path: str) -> Column:
    """The text at a path of a variant; null for anything but text."""
    item = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string"))


def _there(value: Column, path: str) -> Column:
    """Whether the path exists, null values included."""
    return F.try_variant_get(value, path, "variant").isNotNull()


def _items(items: Column, gallery: bool) -> Column:
    """(cid, alt) of each element of an array of variants that names an image; other elements are passed over."""

    def cid(i: Column, image: str) -> Column:
        return F.coalesce(_string(i, f"{image}.ref['$link']"), _string(i, f"{image}.cid"))

    def one(i: Column) -> Column:
        link, alt = cid(i, "$.image"), _string(i, "$.alt")
        if gallery:  # the media beside stands in only where the field itself is not there
            link = F.when(_there(i, "$.image"), link).otherwise(cid(i, "$.media.image"))
            alt = F.when(_there(i, "$.alt"), alt).otherwise(_string(i, "$.media.alt"))
        return F.struct(F.coalesce(link, _string(i, "$.cid")).alias("cid"), F.coalesce(alt, F.lit("")).alias("alt"))

    found = F.filter(F.transform(items, one), lambda x: x["cid"].isNotNull() & (x["cid"] != ""))
    return F.coalesce(found, F.array().cast(_NO_IMAGES))


def images(embed_json: Column) -> Column:
    """Array of (cid, alt) of an embed's images: plain, gallery, or the media beside a quoted record.

    Media may be a bare array of images. An alternative text that is no text is empty.
    """
    return let(F.try_parse_json(embed_json), _images)


def _images(embed: Column) -> Column:
    many = lambda path: F.try_variant_get(embed, path, "array<variant>")

    def plain(root: str) -> Column:
        return _items(F.coalesce(many(f"{root}.images"), many(root)), False)

    def gallery(root: str) -> Column:
        return _items(F.when(_there(embed, f"{root}.items"), many(f"{root}.items")).otherwise(many(f"{root}.images")), True)

    beside = F.filter(F.array(plain("$.media"), gallery("$.media")), lambda found: F.size(found) > 0)
    none = F.array().cast(_NO_IMAGES)
    found = let(
        _string(embed, "$['$type']"),
        lambda kind: F.when(kind == EMBED_IMAGES, plain("$")).when(kind == EMBED_GALLERY, gallery("$")).when(kind == EMBED_WITH_MEDIA, F.get(beside, 0)),
    )
    return F.coalesce(found, none)


def label_values(record_json: Column) -> Column:
    """The self-labels of a record, given as objects or bare strings."""
    values = F.try_variant_get(F.try_parse_json(record_json), "$.labels.values", "array<variant>")
    found = F.transform(values, lambda v: F.coalesce(_string(v, "$.val"), _string(v, "$")))
    return F.coalesce(F.filter(found, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def has_adult_label(record_json: Column) -> Column:
    low = lambda v: F.translate(trimmed(v), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.exists(label_values(record_json), lambda v: low(v).isin(*ADULT_LABELS))


def has_label(record_json: Column, label: str) -> Column:
    """Whether a self-label, trimmed, is exactly this one."""
    return F.exists(label_values(record_json), lambda v: trimmed(v) == label)


def is_moderation_list(record_json: Column) -> Column:
    return F.coalesce(F.get_json_object(record_json, "$.purpose") == MODERATION_LIST, F.lit(False))


def live_message(message_json: Column) -> Column:
    """The message itself, or null if it is a tombstone or no message: id, text, sender's DID and sentAt are texts.

    A revision may be missing, but not be anything else than text; facets are null, missing or an array.
    """
    return F.when(let(F.try_parse_json(message_json), _is_live), message_json)


def _is_live(message: Column) -> Column:
    kind = lambda path: F.schema_of_variant(F.try_variant_get(message, path, "variant"))
    gone = F.coalesce(_string(message, "$['$type']").endswith(DELETED_MESSAGE), F.lit(False))
    fine = [kind(path) == "STRING" for path in ("$.id", "$.text", "$.sender.did", "$.sentAt")]
    rev, facets = kind("$.rev"), kind("$.facets")
    fine += [rev.isNull() | (rev == "STRING"), facets.isNull() | (facets == "VOID") | facets.startswith("ARRAY")]
    whole = F.coalesce(fine[0] & fine[1] & fine[2] & fine[3] & fine[4] & fine[5], F.lit(False))
    return ~gone & whole


def live_messages(messages: Column) -> Column:
    """An array of message documents without tombstones."""
    return F.filter(messages, lambda m: live_message(m).isNotNull())


def has_member(members: Column, did: str) -> Column:
    """Whether an array of structs with a did has this one."""
    return F.coalesce(F.exists(members, lambda m: m["did"] == did), F.lit(False))


def record(kind: str, **fields: Column) -> Column:
    """A record document: its $type and fields; null fields are left out."""
    return F.to_json(F.struct(F.lit(kind).alias("$type"), *[c.alias(n) for n, c in fields.items()]))


def post(text: Column, created_at: Column) -> Column:
    return record("app.bsky.feed.post", text=text, createdAt=created_at)


def follow(subject: Column, created_at: Column) -> Column:
    return record("app.bsky.graph.follow", subject=subject, createdAt=created_at)


def moderation_list(name: Column, created_at: Column) -> Column:
    return record("app.bsky.graph.list", purpose=F.lit(MODERATION_LIST), name=name, createdAt=created_at)


def list_item(subject: Column, list_uri: Column, created_at: Column) -> Column:
    return record("app.bsky.graph.listitem", subject=subject, list=list_uri, createdAt=created_at)


def list_block(list_uri: Column, created_at: Column) -> Column:
    return record("app.bsky.graph.listblock", subject=list_uri, createdAt=created_at)


def strong_ref(uri: Column, cid: Column) -> Column:
    return F.struct(uri.alias("uri"), cid.alias("cid"))
