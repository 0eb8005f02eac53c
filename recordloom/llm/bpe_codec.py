"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the normalised text cuts it where the content says so; equal passages of
different documents therefore give equal chunks, whatever stands before them. A worker encodes each
distinct chunk once and keeps its ids and where its first pre-tokens start. A chunk's edges may cut a pre-token, so
each join is repaired: the text is scanned again from the last pre-token that the left chunk cannot
get wrong, and re-encoded, until a pre-token starts where one of the right chunk starts. From there
both scans are the same scan, since where a pre-token ends depends only on where it starts and on
what follows; the right chunk's ids then hold. The result is the ids of the whole text exactly.

One narrow pass, no shuffle: chunks are reused by all documents of a task, from a store of
bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import pieces, tidied

from recordloom.llm import bpe

#: Characters that the rolling hash sees.
ROLL = 16
#: A chunk ends where the hash has this many leading zero bits: every 1024 characters on average.
ZERO_BITS = 10
SHORTEST, LONGEST = 128, 8192
#: Characters of text whose chunks a task keeps, and pre-tokens whose ids it keeps.
STORE, MEMO = 1 << 22, 1 << 16
#: Starts that a chunk keeps; a join that does not agree within them is re-encoded to the chunk's end.
HEAD = 12
#: Characters after a pre-token's start that decide which kind of pre-token it is ('re, 've, 'll).
AHEAD = 3


def boundaries(text: str) -> list[int]:
    """Where the chunks of a text end; the last end is its length."""
    n = len(text)
    if n <= SHORTEST:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    step = 1
    while step < ROLL:  # the hash of 2 * step characters from two of step characters
        wide = h.copy()
        wide[step:] += h[:-step] << np.uint32(step)
        h, step = wide, 2 * step
    ends, start = [], 0
    for end in [*(np.flatnonzero(h >> np.uint32(32 - ZERO_BITS) == 0) + 1).tolist(), n]:
        while end - start > LONGEST:
            start += LONGEST
            ends.append(start)
        if end - start >= SHORTEST and end < n:
            ends.append(end)
            start = end
    return [*ends, n] if not ends or ends[-1] < n else ends


class Chunk(NamedTuple):
    ids: bytes  # little-endian, 4 bytes each
    head: dict[int, int]  # starts of its first pre-tokens, with the number of ids before each
    sure: int  # start of its last pre-token that is right whatever follows
    sure_ids: int  # ids before that one


class ChunkCodec:
    def __init__(self, path: str):
        self.bpe = bpe.load(path)
        self.memo: dict[str, bytes] = {}
        self.chunks: dict[str, Chunk] = {}
        self.older: dict[str, Chunk] = {}
        self.held = 0

    def normalise(self, text: str) -> str:
        if not bpe.beyond(text):
            return text.lower()  # already composed; white space is between pre-tokens only
        return self.bpe.library.normalizer.normalize_str(text)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens."""
        found = list(map(self.memo.get, pieces))
        if None in found:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    merged = self.bpe.merge(pieces[i])
                    found[i] = struct.pack(f"<{len(merged)}I", *merged)
                    if len(pieces[i]) <= bpe.MEMO_LENGTH:
                        self.memo[pieces[i]] = found[i]
        return found

    def chunk(self, text: str, pattern) -> Chunk:
        """The chunk's encoding, made once while the store holds it."""
        found = self.chunks.get(text)
        if found is None:
            found = self.older.pop(text, None) or self._encode(text, pattern)
            self.chunks[text] = found
            self.held += len(text)
            if self.held > STORE // 2:  # what was not used since the last turn goes
                self.older, self.chunks, self.held = self.chunks, {}, 0
        return found

    def _encode(self, text: str, pattern) -> Chunk:
        pieces = pattern.findall(text)
        parts = self.pieces(pieces)
        ids = b"".join(parts)
        head, n = {}, 0
        for m, part in zip(islice(pattern.finditer(text), HEAD), parts):
            head[m.start()] = n
            n += len(part) // 4
        sure, sure_ids = len(text), len(ids) // 4
        for piece, part in zip(reversed(pieces), reversed(parts)):
            sure = text.rfind(piece, 0, sure)  # only white space follows it there
            sure_ids -= len(part) // 4
            if sure <= len(text) - AHEAD:
                break
        return Chunk(ids, head, sure, sure_ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, added tokens in it included, 4 little-endian bytes each."""
        out = []
        for part, special in self.bpe.parts(text):
            if special:
                out.append(self.bpe.added[part].to_bytes(4, "little"))
            else:
                out += self._joined(self.normalise(part))
        return b"".join(out)

    def _joined(self, text: str) -> list[bytes]:
        """Chunks' ids put together; pre-tokens that start before ``at`` are out."""
        pattern = self.bpe.pattern(text)
        out: list[bytes] = []
        at = begin = 0
        for end in boundaries(text):
            chunk = self.chunk(text[begin:end], pattern)
            first = 0 if begin == 0 else None
            again, scan = [], pattern.finditer(text, at)
            while first is None and (m := next(scan, None)) is not None and m.start() < end:
                first = chunk.head.get(m.start() - begin)
                if first is None:  # the chunk has no such start, or not among its first ones
                    again.append(m[0])
                    at = m.end()
            out += self.pieces(again)
            if first is not None:
                last = len(chunk.ids) // 4 if end == len(text) else chunk.sure_ids
                if last > first:
                    out.append(chunk.ids[4 * first : 4 * last])
                    at = begin + chunk.sure
                else:
                    at = m.start() if begin else 0
            begin = end
        return out

    def decode(self, ids: bytes) -> str:
        """As the library without a decoder: the tokens' own strings, one space between them."""
        strings = self.bpe.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, tokenizer: str, text: str = "text", output: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``output``: the ids of each whole text, 4 bytes each.

    Null and empty texts have no ids (an empty binary). Repeated rows are encoded each; other
    columns pass through, but one named ``output`` is replaced; an empty table gives an empty one.
    """

    @F.arrow_udf("binary")
    @tidied
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = ChunkCodec(tokenizer)  # what it remembers goes with the task
        for batch in batches:
            yield pa.array([c.encode(t.as_py() or "") for t in batch], pa.binary())

    return docs.withColumn(output, ids(F.coalesce(F.col(text), F.lit(""))))


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """``encoded`` with a string column ``output``: the text of a binary column of ids (null: empty)."""

    @F.arrow_udf("string")
    @tidied
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = ChunkCodec(tokenizer)  # what it remembers goes with the task
        for batch in batches:
            yield pa.array([c.decode(i.as_py() or b"") for i in batch], pa.string())

    return encoded.withColumn(output, text(F.col(ids)))


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass over Python: columns ``ids`` and ``decoded``."""

    @F.arrow_udf("struct<ids: binary, decoded: string>")
    @tidied
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = ChunkCodec(tokenizer)  # what it remembers goes with the task
        for texts in (part for batch in batches for part in pieces(batch)):
            coded = [c.encode(t.as_py() or "") for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array(coded, pa.binary()), pa.array([c.decode(i) for i in coded], pa.string())], ["ids", "decoded"]
            )

    result = "__coded"
    return (
        docs.withColumn(result, both(F.coalesce(F.col(text), F.lit(""))))
        .withColumns({ids: F.col(f"{result}.ids"), decoded: F.col(f"{result}.decoded")})
        .drop(result)
    )
