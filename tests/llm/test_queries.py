"""The registered queries column by column, on documents of all odd kinds, against libraries and plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordloom.llm import queries, transport_stream

TEXTS = [
    None, "", " ", "a", "Some plain words.", "é" * 70, "x" * 63, "x" * 64, "x" * 65, "日本語 text\n\n\ttabs", "<|endoftext|> inside <|startoftext|>",
    "it's we're THEY'LL 1234 ²", "word " * 30000, "x" * 40000, "\x00\x01\x1f", "😀" * 3000, "Some plain words.", "a b c " * 340,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, None if i % 3 else "en", "s", None) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_token_counts(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected[i] = (len((t or "").encode()), n, n > 1024)
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op1_token_counts(spark, folder).collect()}
    assert found == expected and {x[2] for x in expected.values()} == {True, False}


def test_encoded_and_decoded_digests(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    expected = {}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i] = (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode()))
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op5_bpe_codec(spark, folder).collect()}
    assert found == expected


def packets(media: bytes):
    """A transport stream read packet by packet: (stamps, random-access points, breaks of the counter, payload)."""
    stamps, points, breaks, parts, last, size = [], 0, 0, [], None, 0
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47
        if (p[1] & 0x1F) << 8 | p[2] != 0x100:
            continue
        if last is not None and p[3] & 15 != (last + 1) % 16:
            breaks += 1
        last = p[3] & 15
        begin = 4
        if p[3] & 0x20:
            begin = 5 + p[4]
            points += bool(p[4] and p[5] & 0x40)
        data = p[begin:]
        if p[1] & 0x40:
            assert data[:4] == b"\x00\x00\x01\xbd" and data[6:9] == b"\x80\x80\x05"
            s = data[9:14]
            stamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
            size = int.from_bytes(data[4:6], "big") - 8
            data = data[14:]
        parts.append(data)
        size -= len(data)
    return stamps, points, breaks, b"".join(parts)


def test_media_columns(spark, folder):
    found = {r["doc_id"]: r.asDict() for r in queries.op7_transport_stream(spark, folder).collect()}
    assert found.keys() == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        media = transport_stream.mux(payload)
        stamps, points, breaks, read = packets(media)
        assert read == payload and stamps == [3600 * k for k in range(-(-len(payload) // 8192))] and breaks == 0
        assert found[i] == {
            "doc_id": i, "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": digest(payload), "tail_crc32": zlib.crc32(payload[-64:]),
            "media_bytes": len(media), "media_sha256": digest(media),
            "feature": f"packets={len(media) // 188};pes={len(stamps)};last_pts={stamps[-1]};random_access={points};discontinuities=0;whole",
        }
