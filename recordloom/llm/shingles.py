"""Word shingles as 64-bit hashes, made in numpy inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Lower-cases A-Z and nothing else, byte by byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd multiplier of the rolling (Rabin-Karp) hash, taken modulo 2 ** 64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` words: a polynomial in BASE over their hashes."""
    n = len(words) - width + 1
    h = words[:n].copy()
    for j in range(1, width):
        h *= BASE
        h += words[j : j + n]
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits, so that the order of the hashes is a random one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text as signed 64-bit hashes.

    Words are what stands between bytes 0x20 and 0x09-0x0D. A text of fewer words than ``width``
    has its whole word sequence as its one shingle; without words the set is empty.
    """
    words = word_hashes((text or "").encode("utf-8").translate(LOWER).split())
    if not len(words):
        return np.empty(0, np.int64)
    h = rolling(words, min(width, len(words)))
    if len(words) < width:  # sequences of another length are other elements
        h = h * BASE + np.uint64(len(words))
    return np.unique(mixed(h).view(np.int64))


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
