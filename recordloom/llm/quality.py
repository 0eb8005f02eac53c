"""Quality scores by positive-unlabelled learning over how a text is written.

Trusted positives are documents labelled good; the unlabelled rows are web text of any kind. The
features say how a text is written, not what about: every word is reduced to its shape (runs of small
letters, capitals, digits; signs as they are), a word that stands twice in a row to a mark of its own. A
feature is a shape, a pair of neighbouring shapes, a length of words, or the share of words in lines that
the text has already had; its value is the root of its share of the words. Features are hashed to
a fixed number of columns, and what each means for quality is learned.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import tidied

from recordloom.llm import pu_learning

#: Rows to fit on at most, whatever the size of the tables, and columns of features.
POSITIVES, UNLABELLED, COLUMNS = 4000, 8000, 4096
#: Parts of a shape that are looked at, and the length from which words count as long.
PARTS, LONGEST = 8, 20
AGAIN = "="
#: Words and features that a worker remembers.
MEMO = 1 << 14


class _Shapes(dict):
    """word -> shape"""

    def __missing__(self, word: str) -> str:
        parts: list[str] = []
        for c in word:
            kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "l" if c.isalpha() else c
            if len(parts) < 2 or (parts[-1], parts[-2]) != (kind, kind):  # one, or more than one
                parts.append(kind)
        shape = self[word] = "".join(parts[: 2 * PARTS])
        return shape


class _Columns(dict):
    """feature -> column"""

    def __missing__(self, feature) -> int:
        column = self[feature] = zlib.crc32(repr(feature).encode()) % COLUMNS
        return column


_shapes, _columns = _Shapes(), _Columns()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and their values; features that share a column stay apart, as they add up in a model anyway."""
    words = text.split()
    if not words:
        return np.array([_columns["no words"]], np.int32), np.ones(1)
    for memo in (_shapes, _columns):
        if len(memo) > MEMO:
            memo.clear()
    shapes = list(map(_shapes.__getitem__, words))
    if any(map(operator.eq, words, words[1:])):
        shapes[1:] = [AGAIN if a == b else s for a, b, s in zip(words, words[1:], shapes[1:])]
    counts: Counter = Counter(shapes)
    counts.update(zip(["", *shapes], shapes))
    counts.update(Counter(min(n, LONGEST) for n in map(len, words)))
    lines = text.split("\n")
    if len(lines) > 1:
        for line, n in Counter(filter(None, lines)).items():
            if n > 1:
                counts["line again"] += (n - 1) * len(line.split())
    counts["size", len(words).bit_length()] = len(words)
    columns = np.fromiter(map(_columns.__getitem__, counts), np.int32, len(counts))
    return columns, np.sqrt(np.fromiter(counts.values(), float, len(counts)) / len(words))


def _features(text: str) -> Column:
    kind = pa.struct([("columns", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    @F.arrow_udf("struct<columns: array<int>, values: array<double>>")
    @tidied
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([dict(zip(kind.names, features(t.as_py() or ""))) for t in batch], kind)

    return made(text)


def train(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> tuple[np.ndarray, float]:
    """Weights and bias, fitted on a bounded sample (see ``pu_learning.samples``)."""
    chosen, prior = pu_learning.samples(docs, labels, label, id, text, positives, unlabelled)
    rows = chosen.select("positive", _features("text").alias("x")).select("positive", "x.*").collect()
    sides = []
    for positive in (True, False):
        mine = [r for r in rows if r["positive"] == positive]
        sides.append(pu_learning.Sparse.of_lists([r["columns"] for r in mine], COLUMNS, [r["values"] for r in mine]))
    return pu_learning.fit(*sides, prior or pu_learning.estimated_prior(*sides), rate=0.1)


def score(text: Column, model: tuple[np.ndarray, float]) -> Column:
    """The chance that a text is good, 0 to 1. Null counts as empty; an empty text has its own score."""
    weights, bias = model

    @F.arrow_udf("double")
    @tidied
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            z = np.empty(len(batch))
            for i, t in enumerate(batch):
                columns, values = features(t.as_py() or "")
                z[i] = bias + weights[columns] @ values
            yield pa.array(pu_learning.logistic(z))

    return scored(F.coalesce(text, F.lit("")))


def with_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", output: str = "score", **sizes) -> DataFrame:
    """``docs`` with a column ``output``: the quality score of each whole text.

    Nulls in any column, empty and repeated rows are scored like others; a column that is called
    ``output`` is replaced; an empty table gives an empty one.
    """
    return docs.withColumn(output, score(F.col(text), train(docs, labels, id, text, **sizes)))
