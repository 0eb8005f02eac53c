"""Mixing sources to target weights by soft membership, with DataFrame functions only.

1. A naive Bayes classifier is counted from a labelled table: how often each domain's documents hold
   each word beginning, word ending and repetition, hashed to a fixed number of buckets. It gives a
   document a posterior over the domains, not one domain.
2. Document rates r >= 0 are fitted by projected gradient so that the expected tokens of each domain,
   sum of r * tokens * posterior, match the targets in relative least squares, with a slight pull of
   all rates to 1:

       1/2 sum_k (S_k - t_k)^2 / (T t_k)  +  pull/2 sum_i (n_i / T) (r_i - 1)^2

   Measured by tokens, a document's gradient depends on its posterior alone:
   sum_k p_ik (S_k - t_k) / t_k + pull * (r_i - 1). Posteriors are measured once and written down
   beside the token counts; a turn is one aggregation of a few sums over those narrow rows, and the
   driver keeps a few numbers for each turn. A document's rate is those turns replayed on its
   posterior, so applying the fit to texts needs no join, and nothing but the numbers has to survive
   a lost executor.
3. If the turns end before the targets are met, or take little off the errors, the fit is taken to its optimum. There a rate is
   max(0, 1 - sum_k p_ik e_k / pull) for relative errors e, which are the minimum of

       sum_k t_k e_k + s_k e_k^2 / 2  +  pull/2 sum_i n_i max(0, 1 - sum_k p_ik e_k / pull)^2

   Newton steps on these few numbers find it, each one aggregation over the same rows, and one turn
   from rate 1 replays it. Errors that are left then are those that no rates undo without more pull
   than they are worth, as for a domain that the documents hardly hold: they are in ``Mixer.errors``,
   and ``fit`` warns of them.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import durable

#: Feature buckets, and labelled documents to count at most.
BUCKETS, TRAIN = 8192, 20000
#: Turns at most, relative error to stop at, and the pull to rate 1.
TURNS, ENOUGH, PULL = 24, 1e-4, 1e-3
#: A turn that leaves more than this share of the largest error is the last one before the Newton steps.
SLOW = 0.7
#: Relative residual at which the optimum counts as found, and relative error of a domain that is warned of.
SETTLED, MISSED = 1e-6, 0.02
#: Share of the tokens that the error of a domain is relative to if its target is zero.
FLOOR = 0.01
#: Log-odds of a document grow with the root of its length: words of a text are not independent.
SPACE = r"[\x20\x09-\x0D]+"


@dataclass
class Mixer:
    domains: list[str]
    weights: np.ndarray  # log-likelihood of each bucket by domain, centred: the domains' sum is 0
    repeats: np.ndarray  # the same of a repeated word and of another one
    prior: list[float]  # log
    turns: list[list[float]]  # relative errors by domain, turn by turn
    step: float
    errors: list[float] = field(default_factory=list)  # relative errors by domain that the rates leave
    met: bool = True  # whether all of them are below what was asked for; if not, the rates are the optimum with the pull


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _bucket_pair(word: Column) -> tuple[Column, Column]:
    """The bucket numbers of a word's beginning and ending."""
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")
    return bucket(F.substring(word, 1, 5)), bucket(F.lit("-"), F.substring(word, -2, 2))


def _buckets(words: Column) -> Column:
    """Each word's beginning and ending as bucket numbers."""
    return F.concat(F.transform(words, lambda w: _bucket_pair(w)[0]), F.transform(words, lambda w: _bucket_pair(w)[1]))


def _repeats(words: Column) -> Column:
    """How many words are the word before them again."""
    again = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b)
    return F.size(F.filter(again, lambda x: x))


def _array(values) -> Column:
    """Numbers as one literal array."""
    return F.split(F.lit(",".join(f"{v:.7g}" for v in values)), ",").cast("array<double>")


def _looked_up(buckets: Column, weights: Column) -> Column:
    """The sum of the buckets' weights."""
    return F.aggregate(buckets, F.lit(0.0), lambda s, b: s + weights[b])


def _measured(docs: DataFrame, text: str, mixer: Mixer) -> DataFrame:
    """``docs`` with __n (tokens, long) and __p (posterior by domain, array of doubles)."""
    rows = docs.withColumn("__words", _words(F.col(text)))
    rows = rows.withColumns(
        {"__n": F.size("__words").cast("long"), "__buckets": _buckets(F.col("__words")), "__r": _repeats(F.col("__words"))}
    )
    scale = F.sqrt(F.greatest(F.col("__n"), F.lit(1)))
    names = [f"__l{j}" for j in range(len(mixer.domains))]
    found = {name: _looked_up(F.col("__buckets"), _array(w)) for name, w in zip(names[:-1], mixer.weights)}
    rows = rows.withColumns(found).withColumn(names[-1], -sum((F.col(x) for x in names[:-1]), F.lit(0.0)))
    logits = [
        (F.col(x) + F.col("__r") * float(yes) + (F.col("__n") - F.col("__r")) * float(no)) / scale + prior
        for x, (yes, no), prior in zip(names, mixer.repeats, mixer.prior)
    ]
    rows = rows.withColumn("__z", F.array(*logits)).withColumn("__top", F.array_max("__z"))
    rows = rows.withColumn("__e", F.transform("__z", lambda z: F.exp(z - F.col("__top"))))
    rows = rows.withColumn("__t", F.aggregate("__e", F.lit(0.0), lambda s, x: s + x))
    rows = rows.withColumn("__p", F.transform("__e", lambda x: x / F.col("__t")))
    return rows.drop("__words", "__buckets", "__r", "__z", "__top", "__e", "__t", *names)


def _rate(posterior: Column, mixer: Mixer, pull: float) -> Column:
    """The turns replayed on a posterior from rate 1 on: each names the rate before it once, so they nest in line."""
    kept = 1.0 - mixer.step * pull
    rate = F.lit(1.0)
    for turn in mixer.turns:
        slope = sum((posterior[j] * float(e * mixer.step) for j, e in enumerate(turn)), F.lit(kept - 1.0))
        rate = F.greatest(F.lit(0.0), rate * kept - slope)
    return rate


def _classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], id: str, text: str) -> Mixer:
    known = labelled.select(F.col("id"), F.col("domain")).where("id is not null").where(F.col("domain").isin(domains))
    known = known.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(TRAIN)
    # at most TRAIN rows: small enough to send to every task whatever the input
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    shares = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    words = rows.select("domain", _words(F.col("text")).alias("w"))
    # a word a row first: hashing rows is compiled, hashing within an array is not; a text's first word brings its repeats along
    each = words.withColumn("r", _repeats(F.col("w"))).select("domain", "r", F.posexplode("w").alias("at", "w"))
    pairs = each.select("domain", F.when(F.col("at") == 0, F.col("r")).otherwise(0).alias("r"), F.array(*_bucket_pair(F.col("w"))).alias("pair"))
    buckets = pairs.select("domain", "r", F.posexplode("pair").alias("side", "b"))
    repeated = F.sum(F.when(F.col("side") == 0, F.col("r")).otherwise(0)).alias("r")
    counted = buckets.groupBy("domain", "b").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("words"), repeated).collect()
    # at most BUCKETS rows for each domain
    counts, again = np.ones((len(domains), BUCKETS)), np.ones((len(domains), 2))
    for r in counted:
        counts[domains.index(r["domain"]), r["b"]] += r["n"]
        again[domains.index(r["domain"])] += r["r"], r["words"] - r["r"]
    logs = [np.log(x / x.sum(1, keepdims=True)) for x in (counts, again)]
    n = sum(shares.values())
    prior = [math.log((shares.get(d, 0) + 1) / (n + len(domains))) for d in domains]
    return Mixer(domains, logs[0] - logs[0].mean(0), logs[1], prior, [], 0.0)


def checked(targets: dict[str, float]) -> dict[str, float]:
    """The targets, or an error that says why they cannot be meant."""
    if not targets:
        raise ValueError("mixing needs the target of at least one domain")
    bad = {d: t for d, t in targets.items() if not (math.isfinite(t) and t >= 0)}
    if bad:
        raise ValueError(f"targets must be finite and not negative: {bad}")
    if sum(targets.values()) == 0:
        raise ValueError("all targets are zero: no rates can keep the number of tokens")
    return targets


def _optimum(weighty: DataFrame, wanted: np.ndarray, scale: np.ndarray, pull: float, start: list[float]) -> list[float]:
    """The errors, relative to ``scale``, at the optimum of the rates, by Newton steps from ``start``; an error if they do not settle."""
    k = len(wanted)

    def at(e: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Height, slope and curve of the function that the errors minimise."""
        rate = F.lit(1.0) - sum((F.col("__p")[j] * float(x / pull) for j, x in enumerate(e)), F.lit(0.0))
        rows = weighty.select("__n", "__p", rate.alias("__r")).where("__r > 0")
        total = lambda c: F.coalesce(F.sum(F.col("__n") * c), F.lit(0.0))
        p = [F.col("__p")[j] for j in range(k)]
        pairs = [(a, b) for a in range(k) for b in range(a, k)]
        sums = rows.agg(total(F.col("__r") * F.col("__r")), *[total(F.col("__r") * x) for x in p], *[total(p[a] * p[b]) for a, b in pairs]).first()
        curve = np.diag(scale.astype(float))
        for (a, b), x in zip(pairs, sums[1 + k :]):
            curve[[a, b], [b, a]] += x / pull
        return float(wanted @ e + scale @ (e * e) / 2) + pull / 2 * sums[0], wanted + scale * e - np.array(sums[1 : 1 + k]), curve

    e = np.array(start, float)
    height, slope, curve = at(e)
    while np.abs(slope / scale).max() > SETTLED:
        move, part = -np.linalg.solve(curve, slope), 1.0
        while (new := at(e + part * move))[0] > height + 1e-4 * part * float(slope @ move) and np.abs(new[1] / scale).max() > SETTLED:
            part /= 2
            if part < 1e-12:
                raise ArithmeticError("the rates do not settle")
        e = e + part * move
        height, slope, curve = new
    return [float(x) for x in e]


def fit(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id: str = "doc_id", text: str = "text",
    turns: int = TURNS, enough: float = ENOUGH, pull: float = PULL, keep_text: bool = False,
) -> tuple[Mixer, DataFrame]:
    """Classifier and rates for ``docs``, and ``docs`` with what ``with_rates`` adds, without the text unless ``keep_text``.

    ``labelled`` has (id, domain); ``targets`` gives each domain's share of the tokens, which are
    normalised; the total stays that of ``docs``. Documents that are labelled more than once have
    the smallest of their domains. Without labels all posteriors are the prior; without tokens all
    rates are 1. Targets must be finite, not negative and not all zero; a domain whose target is zero has
    its error relative to FLOOR of all tokens, and as posteriors are never zero it is warned of if some share is
    left to it. The descent ends where all errors are below ``enough`` (``Mixer.met``), or at the
    optimum; the errors left are in ``Mixer.errors``.
    """
    domains = sorted(checked(targets))
    mixer = _classifier(docs, labelled, domains, id, text)
    shares = np.array([targets[d] for d in domains]) / sum(targets.values())
    k = len(domains)
    base = _measured(docs, text, mixer)
    base = durable(base if keep_text else base.drop(text))
    weighty = base.where("__n > 0").select("__n", "__p")
    moments = weighty.agg(
        F.sum("__n").alias("n"), *[F.sum(F.col("__n") * F.col("__p")[a] * F.col("__p")[b]).alias(f"m{a}_{b}") for a in range(k) for b in range(k)]
    ).first()
    if moments["n"]:
        total = float(moments["n"])
        wanted = shares * total
        scale = np.where(wanted > 0, wanted, FLOOR * total)
        curve = np.array([[moments[f"m{a}_{b}"] for b in range(k)] for a in range(k)]) / np.sqrt(np.outer(scale, scale))
        mixer.step = 1 / (float(np.linalg.eigvalsh(curve).max()) + pull)
        largest = math.inf
        for _ in range(turns):
            weighed = weighty.select((F.col("__n") * _rate(F.col("__p"), mixer, pull)).alias("w"), "__p")
            sums = weighed.agg(*[F.sum(F.col("w") * F.col("__p")[j]).alias(f"s{j}") for j in range(k)]).first()
            errors = [(sums[f"s{j}"] - wanted[j]) / scale[j] for j in range(k)]
            before, largest = largest, max(map(abs, errors))
            if largest < enough or (pull > 0 and largest > SLOW * before):
                break
            mixer.turns.append(errors)
        if largest >= enough:
            if pull <= 0:
                raise ArithmeticError(f"the targets are not met after {turns} turns, and without a pull there is no one optimum")
            errors = _optimum(weighty, wanted, scale, pull, errors if turns else [0.0] * k)
            mixer.turns = [[e / (pull * mixer.step) for e in errors]]
        mixer.errors, mixer.met = errors, max(map(abs, errors)) < enough
        missed = {d: round(e, 4) for d, e in zip(domains, errors) if abs(e) > MISSED}
        if missed:
            warnings.warn(f"mixing: relative errors that the best rates leave: {missed}", stacklevel=2)
    return mixer, _with_rates(base, mixer, pull)


def _with_rates(measured: DataFrame, mixer: Mixer, pull: float) -> DataFrame:
    named = {f"p_{d}": F.col("__p")[j] for j, d in enumerate(mixer.domains)}
    return measured.withColumns({"n_tokens": F.col("__n"), **named, "rate": _rate(F.col("__p"), mixer, pull)}).drop("__n", "__p")


def with_rates(docs: DataFrame, mixer: Mixer, text: str = "text", pull: float = PULL) -> DataFrame:
    """``docs`` with n_tokens, one p_<domain> for each domain, and rate (0 or more).

    Null and empty texts have 0 tokens and the prior as posterior. Repeated rows get equal rates;
    other columns pass through, but those named like a result are replaced; an empty table gives an
    empty one.
    """
    return _with_rates(_measured(docs, text, mixer), mixer, pull)


def mixed(docs: DataFrame, mixer: Mixer, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` repeated by their rates: the whole part, and once more by chance of the fraction.

    The chance is a hash of id and text, so that a rerun gives the same rows. Rows of rate 1 or more stay.
    """
    rows = _measured(_aside(docs), f"in_{text}", mixer)
    # written first: the filter on the copies would take the whole classifier along, many times over
    return _copied(_with_rates(durable(rows), mixer, PULL), docs.columns, id, text)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id: str = "doc_id", text: str = "text") -> tuple[Mixer, DataFrame]:
    """``fit`` and ``mixed`` in one, so that the texts are measured once."""
    mixer, rows = fit(_aside(docs), labelled, targets, f"in_{id}", f"in_{text}", keep_text=True)
    return mixer, _copied(rows, docs.columns, id, text)


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no result has."""
    return docs.select(*[F.col(c).alias(f"in_{c}") for c in docs.columns])


def _copied(rows: DataFrame, columns: list[str], id: str, text: str) -> DataFrame:
    chance = F.pmod(F.xxhash64(f"in_{id}", f"in_{text}"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    rows = rows.withColumn("copies", copies).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"in_{c}").alias(c) for c in columns])
