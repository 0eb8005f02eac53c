"""Exact substring dedup: Rabin-Karp hashes of every 13-word window, counted across documents.

A window is a copy if its word sequence also starts in a document of smaller id. Every window is
hashed and compared; what is shuffled is arranged so that it stays small and even:

* neighbouring windows travel together. Each window is filed under its minimiser, the smallest hash
  among its 5-word grams; equal windows have equal minimisers, and about five neighbours share one.
  Such a **run** is sent as (minimiser, document, position) and a 48-bit hash per window, so that
  windows are compared on 64 + 48 bits;
* equal runs within a task are folded to the one of the smallest document before the shuffle, and
  the others are known to be copies; a passage that a third of all documents hold is sent once for
  each task;
* runs are dealt to blocks by a hash of the minimiser. The number of blocks follows the bytes of
  text, so that a block's windows fit a task at any size of the input. A block that holds far more
  windows than that, as one gram stands in many documents in different contexts, is **split**: its runs are sent window by
  window, dealt by the windows' own hashes. Blocks are counted first, by a pass that sends a number for each.

Blocks answer with copied stretches of word positions, a row each; those of a document are merged into maximal
removal intervals, which meet its text in one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import tidied

from recordloom.llm.shingles import BASE, mixed, rolling, word_hashes

#: Words of the grams among which a window's minimiser is found.
GRAM = 5
#: Bytes of text for each block, and windows that a task gathers before it sends them.
BLOCK_BYTES, GATHER = 8 << 20, 1 << 20
#: Words that are hashed at once; the numbers beside a window's hash are some hundred bytes a word while they are made.
PART = 1 << 16
#: Windows of a run at most.
RUN = 200
#: Bytes of a window's hash.
MARK = 6
#: Parts of a block are numbered in so many bits.
SUB_BITS = 16
#: A block is split if it holds so many times the windows of a middling one, and at least so many.
UNEVEN, LEAST = 2, 1 << 16


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold them all; the width comes first."""
    top = int(values.max()) if len(values) else 0
    width = max(1, (top.bit_length() + 7) // 8) if len(values) == 0 or values.min() >= 0 else 8
    return bytes([width]) + values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<i8").ravel()


PACKED = pa.schema(
    [("block", pa.int32()), ("sub", pa.int32())] + [(c, pa.binary()) for c in ("gram", "doc", "at", "length", "marks", "copied_doc", "copied_at", "copied_length")]
)


def _parts(words: list[np.ndarray], ids: list[int]) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Whole documents, PART words at a time."""
    start = held = 0
    for i, w in enumerate(words, 1):
        held += len(w)
        if held >= PART or i == len(words):
            yield words[start:i], ids[start:i]
            start, held = i, 0


def _runs(words: list[np.ndarray], ids: list[int], window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of some documents: minimiser, document, position, length, first window, hash; and all windows' marks."""
    found, windows = [], 0
    for some, of in _parts(words, ids):
        gram, doc, at, length, first, marks = _runs_at_once(some, of, window)
        found.append((gram, doc, at, length, first + windows, _run_hashes(gram, first, length, marks), marks))
        windows += len(marks)
    return tuple(map(np.concatenate, zip(*found)))


def _run_hashes(gram: np.ndarray, first: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    if not len(first):
        return gram
    weights = mixed((np.arange(len(marks), dtype=np.uint64) - np.repeat(first, length).astype(np.uint64)) + np.uint64(1)) | np.uint64(1)
    return np.add.reduceat(mixed(marks * weights), first) + length.astype(np.uint64) * BASE


def _runs_at_once(words: list[np.ndarray], ids: list[int], window: int) -> tuple[np.ndarray, ...]:
    counts = np.array([len(w) for w in words])
    flat = np.concatenate(words)
    gram = min(GRAM, window)
    grams = mixed(rolling(flat, gram))
    span = window - gram + 1
    n = len(flat) - window + 1
    low = grams[:n].copy()
    for j in range(1, span):
        np.minimum(low, grams[j : j + n], out=low)
    marks = mixed(rolling(flat, window)) >> np.uint64(64 - 8 * MARK)
    ends = np.cumsum(counts)
    which = np.repeat(np.arange(len(counts)), counts)[:n]
    at = np.arange(n) - (ends - counts)[which]
    inside = at + window <= counts[which]
    low, marks, which, at = low[inside], marks[inside], which[inside], at[inside]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (which[1:] != which[:-1])
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(low)))
    if (lengths > RUN).any():  # one gram over and over
        pieces = -(-lengths // RUN)
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + offset * RUN
        lengths = np.diff(np.append(first, len(low)))
    return low[first], np.array(ids, np.int64)[which[first]], at[first], lengths, first, marks


def _spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The windows of runs, run after run."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _block_of(gram: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(gram ^ BASE) % np.uint64(blocks)).astype(np.int32)


def _pack(words: list[np.ndarray], ids: list[int], window: int, blocks: int, splits: dict[int, int]) -> pa.RecordBatch:
    gram, doc, at, length, first, total, marks = _runs(words, ids, window)
    # equal runs, the smallest document first
    order = np.lexsort((at, doc, total, gram))
    g, t, d = gram[order], total[order], doc[order]
    head = np.ones(len(order), bool)
    head[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    least = np.repeat(d[head], np.diff(np.append(np.flatnonzero(head), len(order))))
    copied, sent = order[d > least], order[d == least]
    block = _block_of(gram, blocks)
    cd, ca, cl, cb = doc[copied], at[copied], length[copied], block[copied].astype(np.int64) << SUB_BITS
    gram, doc, at, length, first, block = (x[sent] for x in (gram, doc, at, length, first, block))
    place = block.astype(np.int64) << SUB_BITS
    if splits and (cut := np.isin(block, list(splits))).any():  # window by window
        windows, times = _spread(first[cut], length[cut]), length[cut]
        parts = np.array([splits.get(int(b), 1) for b in block[cut]])
        sub = (mixed(marks[windows] ^ BASE) % np.repeat(parts, times).astype(np.uint64)).astype(np.int64)
        single = (np.repeat(gram[cut], times), np.repeat(doc[cut], times), np.repeat(at[cut] - first[cut], times) + windows, np.ones(len(windows), length.dtype), windows, np.repeat(place[cut], times) + sub)
        gram, doc, at, length, first, place = (np.concatenate([x[~cut], y]) for x, y in zip((gram, doc, at, length, first, place), single))
    rows: dict[str, list] = {name: [] for name in PACKED.names}
    sent = np.argsort(place, kind="stable")  # by minimiser within a block
    copied = np.argsort(cb, kind="stable")
    cd, ca, cl, cb = cd[copied], ca[copied], cl[copied], cb[copied]
    values = np.unique(np.concatenate([place, cb]))
    for b, s, c in zip(
        values,
        np.split(sent, np.searchsorted(place[sent], values[1:])),
        np.split(np.arange(len(cb)), np.searchsorted(cb, values[1:])),
    ):
        w = marks[_spread(first[s], length[s])]
        rows["block"].append(b >> SUB_BITS)
        rows["sub"].append(b & (1 << SUB_BITS) - 1)
        rows["gram"].append(gram[s].tobytes())
        rows["doc"].append(_narrow(doc[s]))
        rows["at"].append(_narrow(at[s]))
        rows["length"].append(_narrow(length[s]))
        rows["marks"].append(w.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :MARK].tobytes())
        rows["copied_doc"].append(_narrow(cd[c]))
        rows["copied_at"].append(_narrow(ca[c]))
        rows["copied_length"].append(_narrow(cl[c]))
    return pa.RecordBatch.from_pydict(rows, PACKED)


def _chunks(batches: Iterator[pa.RecordBatch], window: int, gather: int) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Word hashes and ids of documents that hold a window, ``gather`` words at a time."""
    words: list[np.ndarray] = []
    ids: list[int] = []
    held = 0
    for batch in batches:
        for id, text in zip(batch.column(0), batch.column(1)):
            found = word_hashes((text.as_py() or "").encode("utf-8").split())
            if len(found) >= window:
                words.append(found)
                ids.append(id.as_py())
                held += len(found)
            if held >= gather:
                yield words, ids
                words, ids, held = [], [], 0
    if words:
        yield words, ids


def _windows(window: int, blocks: int, splits: dict[int, int]):
    @tidied
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, ids in _chunks(batches, window, GATHER):
            yield _pack(words, ids, window, blocks, splits)

    return pack


def _sizes(window: int, blocks: int):
    """The windows of each block in a task."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for words, ids in _chunks(batches, window, PART):
            gram, _, _, lengths, _, _ = _runs_at_once(words, ids, window)
            found, at = np.unique(_block_of(gram, blocks), return_inverse=True)
            for b, x in zip(found.tolist(), np.bincount(at, lengths).astype(int).tolist()):
                total[b] = total.get(b, 0) + x
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    return count


def _splits(rows: DataFrame, window: int, blocks: int) -> dict[int, int]:
    """The blocks to split, and in how many parts; a number for each of them reaches the driver."""
    sizes = rows.mapInArrow(_sizes(window, blocks), "block int, n long").groupBy("block").agg(F.sum("n").alias("n"))
    sizes = sizes.persist()
    try:
        total = sizes.agg(F.sum("n")).first()[0] or 0
        fair = max(LEAST, total // blocks)
        return {r["block"]: min(-(-r["n"] // fair), 1 << SUB_BITS) for r in sizes.where(F.col("n") > UNEVEN * fair).collect()}
    finally:
        sizes.unpersist()


COPIED = "doc long, start int, length int"


def _copies(table: pa.Table) -> pa.Table:
    """The copied stretches of a block's windows."""
    column = {name: table.column(name).to_pylist() for name in PACKED.names[2:]}
    gram = np.concatenate([np.frombuffer(x, np.uint64) for x in column["gram"]])
    doc, at, length, cd, ca, cl = (
        np.concatenate([_wide(x) for x in column[name]]) for name in ("doc", "at", "length", "copied_doc", "copied_at", "copied_length")
    )
    raw = np.frombuffer(b"".join(column["marks"]), np.uint8).reshape(-1, MARK)
    del column
    first = np.cumsum(length) - length
    _, where, times = np.unique(gram, return_inverse=True, return_counts=True)
    runs = np.flatnonzero(times[where] > 1)  # other minimisers stand in one run only
    windows = _spread(first[runs], length[runs])
    mark = np.zeros((len(windows), 8), np.uint8)
    mark[:, :MARK] = raw[windows]
    mark = mark.view("<u8").ravel()
    run = np.repeat(runs, length[runs])
    order = np.lexsort((mark, where[run]))
    m, r = mark[order], run[order]
    head = np.ones(len(order), bool)
    head[1:] = (m[1:] != m[:-1]) | (where[r[1:]] != where[r[:-1]])
    if len(order):
        starts = np.flatnonzero(head)
        least = np.repeat(np.minimum.reduceat(doc[r], starts), np.diff(np.append(starts, len(order))))
        found = order[doc[r] > least]
    else:
        found = order
    found_doc = doc[run[found]]
    found_at = at[run[found]] + windows[found] - first[run[found]]
    docs = np.concatenate([found_doc, cd])
    starts = np.concatenate([found_at, ca])
    lengths = np.concatenate([np.ones(len(found), np.int64), cl])
    order = np.lexsort((starts, docs))
    docs, starts, lengths = docs[order], starts[order], lengths[order]
    # neighbouring windows are one stretch
    ends = starts + lengths
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] != ends[:-1])
    at_new = np.flatnonzero(new)
    if len(at_new):
        ends = np.maximum.reduceat(ends, at_new)
    starts = starts[at_new]
    lengths = ends[: len(starts)] - starts
    return pa.table({"doc": docs[at_new], "start": starts.astype(np.int32), "length": lengths.astype(np.int32)})


KEPT = "struct<n_words: long, intervals: array<struct<start: int, end: int>>, kept: string>"


def _cut(window: int):
    interval = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("intervals", pa.list_(interval)), ("kept", pa.string())])

    @F.arrow_udf(KEPT)
    @tidied
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, lengths in batches:
            out = []
            for text, s, n in zip(texts, starts, lengths):
                words = (text.as_py() or "").encode("utf-8").split()
                intervals = []
                if s.is_valid and len(s.values):
                    gone = np.zeros(len(words) + 1, np.int64)
                    begin = np.minimum(s.values.to_numpy(), len(words))
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, np.minimum(begin + n.values.to_numpy() + window - 1, len(words)), -1)
                    covered = np.cumsum(gone)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]])))
                    intervals = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                removed = sum(x["end"] - x["start"] for x in intervals)
                out.append({"n_words": len(words) + removed, "intervals": intervals, "kept": b" ".join(words).decode("utf-8")})
            yield pa.array(out, kind)

    return cut


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """``docs`` with n_words, n_removed, ``removed`` (maximal word intervals, end excluded) and ``kept``.

    A word is removed if a window of ``window`` words over it also starts in a document of smaller
    ``id``; windows are judged on the input. ``kept`` is the other words joined by one space. Null,
    empty and shorter texts lose nothing, nor do rows without an id, whose windows count for nobody.
    Repeated rows lose the same words; rows that share an id but not a text lose the positions found
    in any of them. Other columns pass through, but one named like a result is replaced. An empty
    table gives an empty one.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = rows.where("doc is not null")
    schema = "block int, sub int, " + ", ".join(f"{n} binary" for n in PACKED.names[2:])
    packed = rows.mapInArrow(_windows(window, blocks, _splits(rows, window, blocks)), schema)
    copied = (
        packed.groupBy("block", "sub")
        .applyInArrow(_copies, COPIED)
        .groupBy("doc")
        .agg(F.collect_list("start").alias("__starts"), F.collect_list("length").alias("__lengths"))
        .withColumnRenamed("doc", "__doc")
    )
    joined = docs.join(copied, docs[id].cast("long") == copied["__doc"], "left")
    cut = joined.withColumn("__cut", _cut(window)(F.col(text), F.col("__starts"), F.col("__lengths")))
    return cut.withColumns(
        {
            "n_words": F.col("__cut.n_words"),
            "n_removed": F.aggregate("__cut.intervals", F.lit(0), lambda n, x: n + x["end"] - x["start"]).cast("long"),
            "removed": F.col("__cut.intervals"),
            "kept": F.col("__cut.kept"),
        }
    ).drop("__doc", "__starts", "__lengths", "__cut")
