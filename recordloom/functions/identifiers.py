"""Record URIs, keys and sortable timestamp identifiers as Column functions.

All functions are null in, null out unless they say otherwise; none needs Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the protocol.
TID_ALPHABET = "234567abcdefghijklmnopqrstuvwxyz"
TID_LENGTH = 13
TID_SECONDS = (1668643200, 4102444800)
POSTS = "app.bsky.feed.post"
_URI = r"\Aat://([^/]+)/([^/]+)/([^/]+)\z"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def format_uri(did: Column | str, collection: Column | str, rkey: Column | str) -> Column:
    """``at://did/collection/rkey``; the parts are not checked."""
    return F.concat(F.lit("at://"), _c(did), F.lit("/"), _c(collection), F.lit("/"), _c(rkey))


def split_uri(uri: Column | str) -> Column:
    """Struct (did, collection, rkey) of a URI of exactly three non-empty parts, else null."""
    uri = _c(uri)
    part = lambda i: F.regexp_extract(uri, _URI, i)
    return F.when(uri.rlike(_URI), F.struct(part(1).alias("did"), part(2).alias("collection"), part(3).alias("rkey")))


def did_of_uri(uri: Column | str) -> Column:
    """The first segment if it starts with ``did:``; what follows it need not be there."""
    uri = _c(uri)
    first = F.substring_index(F.substring(uri, 6, 1 << 30), "/", 1)
    return F.when(uri.startswith("at://") & first.startswith("did:"), first)


def did_of_ref(ref: Column) -> Column:
    """The DID of a reference, a struct with a uri: of what a record quotes, likes or answers."""
    return did_of_uri(ref["uri"])


def parent_did(reply: Column) -> Column:
    """Whom a reply answers; ``reply`` is a struct with the references root and parent."""
    return did_of_ref(reply["parent"])


def root_did(reply: Column) -> Column:
    """Who began the thread of a reply."""
    return did_of_ref(reply["root"])


def did_for_collection(uri: Column | str, collection: str) -> Column:
    """The DID of a whole URI in this collection, else null."""
    parts = split_uri(uri)
    return F.when((parts["collection"] == collection) & parts["did"].startswith("did:"), parts["did"])


def post_of_uri(uri: Column | str) -> Column:
    """Struct (author, rkey) if the URI names a post; the author may be a handle."""
    parts = split_uri(uri)
    return F.when(parts["collection"] == POSTS, F.struct(parts["did"].alias("author"), parts["rkey"].alias("rkey")))


def is_valid_rkey(rkey: Column | str) -> Column:
    rkey = _c(rkey)
    return rkey.rlike(r"\A[A-Za-z0-9._~-]{1,512}\z") & ~rkey.isin(".", "..")


def trimmed(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def is_valid_did(did: Column | str) -> Column:
    did = trimmed(_c(did))
    return did.rlike(r"\Adid:[A-Za-z0-9:._%-]*\z") & (F.length(did) >= 7) & (F.size(F.split(did, ":")) >= 3)


def is_valid_collection(collection: Column | str) -> Column:
    name = trimmed(_c(collection))
    return name.rlike(r"\A[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\z") & (F.octet_length(name) <= 317)


def operation_of(text: Column | str) -> Column:
    """create, update or delete in any case, else null."""
    low = F.translate(_c(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(low.isin("create", "update", "delete"), low)


def tid_micros(tid: Column | str) -> Column:
    """Microseconds of a timestamp identifier; null unless 13 characters of its alphabet with a clear top bit."""
    tid = _c(tid)
    letters = F.split(F.when(tid.rlike(rf"\A[2-7a-z]{{{TID_LENGTH}}}\z"), tid), "")
    digits = F.transform(letters, lambda c: (F.position(c, F.lit(TID_ALPHABET)) - 1).cast("long"))
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.shiftleft(a, 5).bitwiseOR(d))
    return F.when(value >= 0, F.shiftright(value, 10))


def tid_seconds(tid: Column | str) -> Column:
    """Whole seconds of a timestamp identifier, null outside the years it can come from."""
    seconds = F.floor(tid_micros(tid) / 1000000)
    return F.when(seconds.between(*TID_SECONDS), seconds)


def tid_encode(micros: Column | str, clock: int = 0) -> Column:
    """The 13 characters of a time in microseconds; ``clock`` fills the low ten bits."""
    return _letters(F.shiftleft(_c(micros).cast("long").bitwiseAND(F.lit((1 << 53) - 1)), 10).bitwiseOR(F.lit(clock & 1023).cast("long")))


def _letters(value: Column) -> Column:
    at = lambda k: F.shiftright(value, 5 * k).bitwiseAND(F.lit(31)).cast("int")
    letters = F.split(F.lit(TID_ALPHABET), "")
    return F.concat(*[letters[at(k)] for k in reversed(range(TID_LENGTH))])


def with_tids(rows: DataFrame, micros: str, order: list[str], by: list[str] = (), output: str = "tid") -> DataFrame:
    """``rows`` with unique, strictly rising timestamp identifiers in the order of ``order``, for each value of ``by``.

    Each is that of its time, or one more than the one before where that is not larger: with c the
    times and i the place, the running maximum of c - i, plus i. Without ``by`` all rows are numbered in one task.
    """
    arrival = Window.partitionBy(*[F.col(c) for c in by]).orderBy(*order)
    place = F.row_number().over(arrival).cast("long")
    value = F.shiftleft(_c(micros).cast("long").bitwiseAND(F.lit((1 << 53) - 1)), 10)
    rows = rows.withColumn("__place", place).withColumn("__ahead", value - F.col("__place"))
    rows = rows.withColumn("__value", F.max("__ahead").over(arrival.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__place"))
    return rows.withColumn(output, _letters(F.col("__value"))).drop("__place", "__ahead", "__value")


def escape_like(text: Column | str) -> Column:
    """Backslash before backslash, percent and underscore."""
    text = F.replace(_c(text), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def thumbnail_url(host: str, did: Column | str, cid: Column | str) -> Column:
    return F.concat(F.lit(f"{host.rstrip('/')}/img/feed_thumbnail/plain/"), _c(did), F.lit("/"), _c(cid), F.lit("@jpeg"))


#: The chat service, and the entryway that opens sessions but passes no chat calls on.
CHAT_HOST, ENTRYWAY_HOST = "api.bsky.chat", "bsky.social"
PDS, PDS_TYPE = "#atproto_pds", "AtprotoPersonalDataServer"


def _host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(url), r"(?i)\A[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def is_chat_service(url: Column | str) -> Column:
    """Whether a URL names the chat service itself; a text that is no URL does if it holds the name."""
    return F.when(_c(url).contains("://"), _host(url) == CHAT_HOST).otherwise(_c(url).contains(CHAT_HOST))


def is_entryway(url: Column | str) -> Column:
    return _host(url) == ENTRYWAY_HOST


def pds_endpoint(did_document: Column | str) -> Column:
    """The data server that an identity document (JSON) names: the first of its kind with an http(s) address; null for none."""
    services = F.from_json(F.get_json_object(_c(did_document), "$.service"), "array<struct<id: string, type: string, serviceEndpoint: string>>")
    address = lambda s: F.rtrim(trimmed(s["serviceEndpoint"]), F.lit("/"))
    fine = lambda s: s["id"].endswith(PDS) & F.coalesce(s["type"], F.lit("")).isin("", PDS_TYPE) & address(s).rlike(r"(?i)\Ahttps?://[^/?#]")
    return F.get(F.transform(F.filter(services, fine), address), 0)


def session_base_url(pds: Column | str, chat: Column | str, did_document: Column | str) -> Column:
    """Struct (url, may_change): where the chat calls of a session go.

    An address for chats that is neither the service, nor the entryway, nor the data server is kept for
    good; else the data server of the identity document is taken, or the one given unless it is the
    entryway, or what there is.
    """
    clean = lambda c: F.rtrim(trimmed(F.coalesce(_c(c), F.lit(""))), F.lit("/"))
    pds, chat, found = clean(pds), clean(chat), pds_endpoint(did_document)
    own = (chat != "") & ~is_chat_service(chat) & ~is_entryway(chat) & (chat != pds)
    given = ((chat == "") | is_chat_service(chat)) & (pds != "") & ~is_entryway(pds)
    url = F.when(own, chat).when(found.isNotNull(), found).when(given, pds).when(chat != "", chat).otherwise(pds)
    return F.struct(url.alias("url"), (~own).alias("may_change"))


def is_recoverable_expiry(status: Column | str, body: Column | str) -> Column:
    """Whether an answer says that a session has run out and can be renewed."""
    wrong = _c(body).contains("BadJwtType") | _c(body).contains("BadTokenScope")
    return ~wrong & ((_c(status) == 401) | ((_c(status) == 400) & _c(body).contains("ExpiredToken")))
