"""Toxicity scores by non-negative positive-unlabelled learning over word features.

Confirmed toxic documents are the positives, text of any kind is unlabelled. A document's features
are its lower-case words and their first four to seven letters, so that inflected and compounded
forms of a word are seen as one, each with marks for two and four occurrences or more. The features
that positives hold significantly more often are chosen by a count in Spark; a numpy classifier
weighs them under the prior-corrected risk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import tidied

from recordloom.llm import pu_learning

#: Rows to fit on and features to weigh at most, whatever the size of the tables.
POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 4096
#: Positive documents in which a feature must occur, and by how many standard errors it must be more frequent there.
LEAST, ERRORS = 3, 5.0
#: Longer words are known by their beginnings only.
WORD = 40
BEGINNINGS = (4, 5, 6, 7)
_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words as they are, beginnings with a dash; a number after either: it occurs so often."""
    counts: dict[str, int] = {}
    for word in _WORDS.findall(text.lower()):
        counts[word] = counts.get(word, 0) + 1
    seen = {w: n for w, n in counts.items() if len(w) <= WORD}
    for word, n in counts.items():
        for k in BEGINNINGS:
            if len(word) > k:
                begin = word[:k] + "-"
                seen[begin] = seen.get(begin, 0) + n
    return {*seen, *(f + "2" for f, n in seen.items() if n > 1), *(f + "4" for f, n in seen.items() if n > 3)}


def _features(text: str) -> Column:
    @F.arrow_udf("array<string>")
    @tidied
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([list(features(t.as_py() or "")) for t in batch], pa.list_(pa.string()))

    return made(text)


def _chosen(sample: DataFrame, limit: int) -> list[str]:
    """The features that positives hold significantly more often, the clearest first, at most ``limit``."""
    size = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = size.get(True, 1), size.get(False, 1)
    p, u = F.col("p") / n_p, F.col("u") / n_u
    pooled = (F.col("p") + F.col("u")) / (n_p + n_u)
    errors = (p - u) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    counts = (
        sample.select("positive", F.explode(_features("text")).alias("f"))
        .groupBy("f")
        .agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
        .where((F.col("p") >= LEAST) & (errors >= ERRORS))
    )
    best = counts.orderBy(errors.desc(), "f").limit(limit)
    return [r["f"] for r in best.select("f").collect()]


def _indices(names: list[str]):
    @F.arrow_udf("array<int>")
    @tidied
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = {f: i for i, f in enumerate(names)}
        for batch in batches:
            yield pa.array([[place[f] for f in features(t.as_py() or "") if f in place] for t in batch], pa.list_(pa.int32()))

    return found


def train(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, limit: int = FEATURES,
) -> tuple[dict[str, float], float]:
    """Weights of features and the bias, fitted on a bounded sample (see ``pu_learning.samples``)."""
    sample, prior = pu_learning.samples(docs, labels, label, id, text, positives, unlabelled)
    names = _chosen(sample, limit)
    rows = sample.select("positive", _indices(names)("text").alias("x")).collect()
    side = lambda positive: pu_learning.Sparse.of_lists([r["x"] for r in rows if r["positive"] == positive], len(names))
    sides = side(True), side(False)
    weights, bias = pu_learning.fit(*sides, prior or pu_learning.estimated_prior(*sides), steps=600, rate=0.1)
    return dict(zip(names, weights.tolist())), bias


def score(text: Column, model: tuple[dict[str, float], float]) -> Column:
    """The chance that a text is toxic, 0 to 1. Null counts as empty."""
    weights, bias = model

    @F.arrow_udf("double")
    @tidied
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = weights.keys()
        for batch in batches:
            z = [bias + sum(weights[f] for f in sorted(features(t.as_py() or "") & known)) for t in batch]
            yield pa.array(pu_learning.logistic(np.array(z, float)))

    return scored(F.coalesce(text, F.lit("")))


def with_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", output: str = "score", **sizes) -> DataFrame:
    """``docs`` with a column ``output``: the toxicity score of each whole text.

    Nulls in any column, empty and repeated rows are scored like others; a column that is called
    ``output`` is replaced; an empty table gives an empty one.
    """
    return docs.withColumn(output, score(F.col(text), train(docs, labels, id, text, **sizes)))
