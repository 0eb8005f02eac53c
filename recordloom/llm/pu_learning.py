"""Positive-unlabelled learning: a linear classifier that minimises the non-negative unbiased risk.

With class prior p, trusted positives P and unlabelled rows U, and the logistic loss l, the risk is

    p * mean_P l(z) + max(0, mean_U l(-z) - p * mean_P l(-z))

whose second term estimates the loss on negatives without any labelled negative. Where that term is
negative, the step goes up along it instead, so that the model cannot fit noise below zero. Scores
are posteriors: logistic(z) estimates the chance of label 1.

The prior p is the share of positives among the labelled ids, which assumes that ids were picked for
labelling without regard to their label. Where only positives are labelled it is estimated from
scores of the unlabelled rows (``estimated_prior``), which needs more of them. Labels of 0 have no other use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import durable, held_out


@dataclass
class Sparse:
    """Rows of features: entry i is ``value[i]`` of column ``column[i]`` in row ``row[i]``."""

    n_rows: int
    n_columns: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray

    @classmethod
    def of_dense(cls, x: np.ndarray) -> Sparse:
        row, column = np.nonzero(x)
        return cls(*x.shape, row, column, x[row, column])

    @classmethod
    def of_lists(cls, lists: list, n_columns: int, values: list | None = None) -> Sparse:
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        column = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.empty(0, np.int64)
        value = np.concatenate([np.asarray(x, float) for x in values]) if values else np.ones(len(column))
        return cls(len(lists), n_columns, row, column.astype(np.int64), value)

    def only(self, rows: np.ndarray) -> Sparse:
        """The rows that a mask marks."""
        kept = rows[self.row]
        return Sparse(int(rows.sum()), self.n_columns, (np.cumsum(rows) - 1)[self.row[kept]], self.column[kept], self.value[kept])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n_rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.n_columns)


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descent(slopes: Callable[[np.ndarray, float], np.ndarray], w: np.ndarray, bias: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Full-batch Adam from ``w`` and ``bias`` on; ``slopes`` gives those of the weights and, last, of the bias."""
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = slopes(w, bias)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def estimated_prior(positive: Sparse, unlabelled: Sparse, steps: int = 200, rate: float = 0.1, shrink: float = 1e-3) -> float:
    """The share of positives among the unlabelled rows, without any labelled negative.

    A classifier of positives against unlabelled rows is fitted on every other row and scores the
    rest. Where a share q of the positives scores above a threshold and a share a of the unlabelled
    does, a / q is the prior plus what negatives score there; so the prior is the least of a / q, each
    taken with its standard error, over thresholds that half to 95 % of the positives pass. It is kept
    within 0.001 and 0.999, and is 0.5 with fewer than 8 positives or unlabelled rows.
    """
    if min(positive.n_rows, unlabelled.n_rows) < 8:
        return 0.5
    even = [np.arange(x.n_rows) % 2 == 0 for x in (positive, unlabelled)]
    p, u = positive.only(even[0]), unlabelled.only(even[1])

    def slopes(w: np.ndarray, bias: float) -> np.ndarray:
        gp = -logistic(-(p.times(w) + bias)) / p.n_rows / 2
        gu = logistic(u.times(w) + bias) / u.n_rows / 2
        return np.append(p.back(gp) + u.back(gu) + shrink * w, gp.sum() + gu.sum())

    w, _ = _descent(slopes, np.zeros(p.n_columns), 0.0, steps, rate)
    zp, zu = positive.only(~even[0]).times(w), unlabelled.only(~even[1]).times(w)
    found = []
    for part in np.arange(0.5, 0.96, 0.05):
        threshold = np.quantile(zp, 1 - part)
        passed, among = (zp >= threshold).mean(), (zu >= threshold).mean()
        found.append((among + (among * (1 - among) / len(zu)) ** 0.5) / passed)
    return float(min(max(min(found), 0.001), 0.999))


def fit(
    positive: Sparse, unlabelled: Sparse, prior: float, steps: int = 300, rate: float = 0.05, shrink: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias, by full-batch Adam on the non-negative risk. ``shrink``: L2 on the weights.

    Without positives or without unlabelled rows the score is the prior for every row.
    """
    w, bias = np.zeros(positive.n_columns), float(np.log(prior / (1 - prior)))
    if not positive.n_rows or not unlabelled.n_rows:
        return w, bias

    def slopes(w: np.ndarray, bias: float) -> np.ndarray:
        zp, zu = positive.times(w) + bias, unlabelled.times(w) + bias
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = logistic(zu) / unlabelled.n_rows
        down = -prior * logistic(zp) / positive.n_rows
        gain = -prior * logistic(-zp) / positive.n_rows
        gp, gu = (gain + down, up) if negative >= 0 else (-down, -up)
        return np.append(positive.back(gp) + unlabelled.back(gu) + shrink * w, gp.sum() + gu.sum())

    return _descent(slopes, w, bias, steps, rate)


def samples(
    docs: DataFrame, labels: DataFrame, label: str, id: str, text: str, positives: int, unlabelled: int
) -> tuple[DataFrame, float | None]:
    """The rows to fit on (text, positive), and the class prior, None if no id is labelled 0.

    At most ``positives`` trusted positives and ``unlabelled`` rows of any kind, each the rows whose
    id has the smallest hash, so that the choice depends on nothing else. Held-out ids are in
    neither. An id that is labelled more than once is positive if any of its labels is; of texts that
    share an id the smallest is taken. The prior is kept within 0.001 and 0.999.
    """
    known = (
        labels.select(F.col(id).alias("id"), F.col(label).alias("y"))
        .where("id is not null and y is not null")
        .where(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    share = known.agg(F.avg(F.when(F.col("y") == 1, 1.0).otherwise(0.0))).first()[0]
    prior = None if share in (None, 1.0) else min(max(share, 0.001), 0.999)
    trusted = known.where("y = 1").select("id").orderBy(F.xxhash64("id"), "id").limit(positives)
    ids = docs.select(F.col(id).alias("id")).where("id is not null").where(~held_out(F.col("id")))
    other = ids.distinct().orderBy(F.xxhash64("id", F.lit(1)), "id").limit(unlabelled)
    # at most positives + unlabelled ids: small enough to send to every task whatever the input
    chosen = trusted.select("id", F.lit(True).alias("positive")).union(other.select("id", F.lit(False).alias("positive")))
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one = rows.join(F.broadcast(chosen), "id").groupBy("id", "positive").agg(F.min("text").alias("text"))
    return durable(one.orderBy(F.xxhash64("id"), "id", "positive").select("text", "positive")), prior
