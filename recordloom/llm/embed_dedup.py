"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A filter is a random direction; a vector is in it if their inner product exceeds a height. Near vectors
exceed the same directions far more often than others do. Directions are products: a rotated vector is cut in
two halves, each half has a code of random unit words, and every pair of words is a direction. So the
directions that a vector exceeds are listed from its two rows of inner products alone: a word whose product
falls short even with the best word of the other half is left out with all its directions (list decoding).

Vectors meet where they share a filter, and links are verified there on the original vectors in double precision. A
pair that shares several filters counts in the first of them only, so links are counted and not listed: a filter
gives a number for each vector and a spanning forest of its links, never its pairs. Equal vectors are one class before all
this. Codes are integers, so that what a vector exceeds does not depend on who works it out.

The height is calibrated: of random pairs at the similarity itself, each of CODES independent codes misses
MISS of them at most; a pair at the threshold is missed with a chance of MISS ** CODES, nearer ones with far
less, as a vector that exceeds few directions takes its LEAST best ones of each code. The number of words grows with the root of the number of vectors, so that the expected number of strangers in a filter
stays the same.

A filter with more than BLOCK vectors elects a pivot, and vectors within half the angle of the threshold around it
are a **ball**: all of them are linked with one another, by the triangle inequality, and are counted without being compared. The rest
of a large filter is cut into blocks, and tiles of two blocks are compared, but for those within one ball.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import acos, ceil, cos, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import durable, finite, hot_join, matrix, tidied
from recordloom.llm.components import components

#: Independent codes, and the share of pairs at the threshold that one may miss.
CODES, MISS = 4, 0.1
#: A vector that exceeds fewer directions of a code takes so many of its best.
LEAST = 12
#: Directions of a code for each vector, and the least number of words of a half.
DIRECTIONS, WORDS = 16, 64
#: Components are integers of so many bits in the codes; shorter vectors are filled up with zeros to DIMENSIONS.
BITS, DIMENSIONS = 14, 16
#: Pairs that the height is calibrated on, and the best words of a half that they are looked for in.
PAIRS, BEST = 1024, 48
#: Vectors of a block of a filter; larger filters elect pivots in so many turns at most, and the rest is compared.
BLOCK, TURNS = 512, 4
#: Tiles of so many rows are looked through all at once.
SMALL = 32
#: Rounding that a ball's members stand off from the bound.
SLACK = 1e-9


def directed(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


class Code:
    """A product code for vectors of ``d`` components: ``words`` words for each half of a rotated vector."""

    def __init__(self, d: int, words: int, seed: int):
        rng = np.random.default_rng([d, words, seed])
        self.d, self.words, self.padded = d, words, max(d, DIMENSIONS)
        one = 1 << BITS
        self.rotation = np.rint(np.linalg.qr(rng.normal(size=(self.padded, self.padded)))[0] * one)
        half = self.padded // 2
        halves = [rng.normal(size=(words, n)) for n in (half, self.padded - half)]
        self.halves = [np.rint(h / np.linalg.norm(h, axis=1, keepdims=True) * one) for h in halves]

    def products(self, directions: np.ndarray) -> list[np.ndarray]:
        """Inner products of each row of length 1 with the words of each half: whole numbers, exact in doubles."""
        rows = np.rint(directions * (1 << BITS))
        turned = np.rint(rows @ self.rotation[: self.d] / (1 << BITS))
        half = self.padded // 2
        return [turned[:, :half] @ self.halves[0].T, turned[:, half:] @ self.halves[1].T]

    def calibrated(self, similarity: float, miss: float) -> float:
        """The height that all but ``miss`` of random pairs at ``similarity`` exceed together in some direction.

        The best common direction is looked for among pairs of the BEST words of either half, so it is
        no higher than the true one and the height errs to the safe side.
        """
        rng = np.random.default_rng([self.d, self.words, 99])
        a = directed(rng.normal(size=(PAIRS, self.d)))
        if self.d == 1:
            b = a
        else:
            other = rng.normal(size=(PAIRS, self.d))
            other = directed(other - (other * a).sum(1, keepdims=True) * a)
            b = similarity * a + sqrt(max(0.0, 1 - similarity**2)) * other
        of_a, of_b = self.products(a), self.products(b)
        few = min(BEST, self.words)
        tops = [np.argpartition(-(x + y), few - 1, axis=1)[:, :few] for x, y in zip(of_a, of_b)]
        pick = lambda of: np.take_along_axis(of[0], tops[0], 1)[:, :, None] + np.take_along_axis(of[1], tops[1], 1)[:, None, :]
        together = np.minimum(pick(of_a), pick(of_b)).max(axis=(1, 2))
        return float(np.sort(together)[int(miss * PAIRS)])

    def exceeded(self, directions: np.ndarray, height: float) -> Iterator[np.ndarray]:
        """The directions that each row exceeds, as first word * words + second.

        A row that exceeds fewer than LEAST has its height lowered to its LEAST-th best direction.
        """
        first, second = self.products(directions)
        most_first, most_second = first.max(1), second.max(1)
        for a, b, top_a, top_b in zip(first, second, most_first, most_second):
            i, j = np.flatnonzero(a >= height - top_b), np.flatnonzero(b >= height - top_a)
            x, y = np.nonzero(a[i][:, None] + b[j] >= height)
            if len(x) < LEAST:  # the best directions are pairs of the best words
                best = np.sort(np.partition(a, -LEAST)[-LEAST:][:, None] + np.partition(b, -LEAST)[-LEAST:], axis=None)
                lower = best[-LEAST]
                i, j = np.flatnonzero(a >= lower - top_b), np.flatnonzero(b >= lower - top_a)
                x, y = np.nonzero(a[i][:, None] + b[j] >= lower)
            yield i[x] * self.words + j[y]


@functools.lru_cache(maxsize=8)
def codes(d: int, words: int, similarity: float) -> list[tuple[Code, float]]:
    """The codes for vectors of ``d`` components with their heights; the same in every task."""
    made = [Code(d, words, seed) for seed in range(CODES)]
    return [(code, code.calibrated(similarity, MISS)) for code in made]


def filters(directions: np.ndarray, words: int, similarity: float) -> list[np.ndarray]:
    """The filters of each row, numbered through all codes."""
    found = [list(code.exceeded(directions, height)) for code, height in codes(directions.shape[1], words, similarity)]
    return [np.concatenate([f + c * words * words for c, f in enumerate(row)]) for row in zip(*found)]


def _listed(words: int, similarity: float):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column("d"))
            for d in np.unique(sizes):
                mine = batch.filter(pa.array(sizes == d))
                for start in range(0, len(mine), 1024):
                    part = mine.slice(start, 1024)
                    found = filters(directed(matrix(part.column("v"))), words, similarity)
                    times = pa.array(np.repeat(np.arange(len(part)), [len(f) for f in found]))
                    yield pa.RecordBatch.from_arrays([part.column("group").take(times), part.column("node").take(times), pa.array(np.concatenate(found).astype(np.int64))], ["group", "node", "filter"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the smallest row that it is connected with."""
    labels = np.arange(len(linked))
    while True:
        near = np.where(linked, labels, len(labels)).min(1)
        new = np.minimum(labels, near)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _verified(words: int, similarity: float):
    """Links of each tile, of rows sorted by tile: (node, links, other) where other is a node it is connected with."""

    def tile(t: pa.Table) -> list[tuple[int, int, int]]:
        x = directed(matrix(t.column("v")))
        linked = x @ x.T >= similarity
        linked &= ~np.eye(len(x), dtype=bool)
        if not linked.any():
            return []
        side, ball = t.column("block").to_numpy(), t.column("ball").to_numpy()
        if t.column("low")[0].as_py() != t.column("high")[0].as_py():
            linked &= side[:, None] != side
        linked &= (ball[:, None] != ball) | (ball[:, None] < 0)
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            return []
        # of those a pair counts here only if it shares no filter before this one
        linked = linked[np.ix_(some, some)]
        mine = t.column("filter")[0].as_py()
        earlier = [f[f < mine] for f in filters(x[some], words, similarity)]
        values, at = np.unique(np.concatenate(earlier), return_inverse=True)
        held = np.zeros((len(some), len(values)), np.float32)
        held[np.repeat(np.arange(len(some)), [len(f) for f in earlier]), at] = 1
        linked &= held @ held.T == 0
        nodes, rows = t.column("node").to_numpy()[some], t.column("m").to_numpy()[some]
        counts, roots = linked @ rows, _forest(linked)
        return [(int(n), int(c), int(nodes[r])) for n, c, r in zip(nodes, counts, roots) if c]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64()]
        send = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["node", "links", "other"])
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            edges = _edges(t)
            found = [row for a, b in zip(*_linking(t, edges[:-1], similarity)) for row in tile(t.slice(a, b - a))]
            if found:
                yield send(found)
            rest = t.slice(edges[-2]) if len(t) else None
        if rest is not None and len(rest) > 1 and (found := tile(rest)):
            yield send(found)

    return run


def _linking(t: pa.Table, edges: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Where the tiles begin and end that may hold a link; small ones are compared all at once, row by next row."""
    starts, ends = edges[:-1], edges[1:]
    sizes = ends - starts
    wanted = sizes > SMALL
    small = np.flatnonzero((sizes > 1) & ~wanted)
    rows = np.concatenate([np.arange(a, b) for a, b in zip(starts[small], ends[small])] or [np.zeros(0, int)])
    if len(rows):
        part = t.take(pa.array(rows))
        lengths = np.unique(part.column("d").to_numpy())
        if len(lengths) > 1:
            wanted[small] = True
        else:
            x = directed(matrix(part.column("v")))
            of = np.repeat(small, sizes[small])
            for k in range(1, SMALL):
                near = np.flatnonzero(of[k:] == of[:-k])
                if not len(near):
                    break
                wanted[of[near[np.einsum("ij,ij->i", x[near], x[near + k]) >= similarity - SLACK]]] = True
    return starts[wanted].tolist(), ends[wanted].tolist()


def _edges(t: pa.Table) -> np.ndarray:
    """Where the tiles of a sorted table begin, and its end."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for name in ("group", "filter", "low", "high"):
        values = t.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(t))


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", similarity: float = 0.93
) -> DataFrame:
    """One row per row of ``vectors``: ``id``, n_links, component_id and kept.

    Vectors of one label and one length are linked if their cosine is at least ``similarity`` (above 0). n_links counts
    the rows linked with a row, its copies among them; a component is what links connect, named by its smallest
    id; ``kept`` marks the row of that id. A row without an id links others and is in their component, but does not name
    it; where no row has an id the component is null; it is kept if it is linked with nothing. Rows that repeat
    an id are vectors of their own. Rows without a label or with a vector that is null, empty, zero or holds null or non-finite
    numbers are linked with nothing and are kept. No rows give no rows. Other columns play no part.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    rows = vectors.select(F.col(id).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.col("label").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    # equal vectors of a label are a class, named by two hashes
    h1, h2 = F.xxhash64("label", "v"), F.xxhash64(F.lit(1), "v", "label")
    light = durable(rows.select("id", usable.alias("usable"), F.when(usable, h1).alias("h1"), F.when(usable, h2).alias("h2")))
    classes = rows.where(usable).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("m"))
    group = F.xxhash64("label", F.size("v"))
    classes = durable(classes.select(h1.alias("h1"), h2.alias("h2"), group.alias("group"), F.size("v").alias("d"), "v", "rep", "m", F.monotonically_increasing_id().alias("node")))
    n = classes.count()
    words = max(WORDS, 1 << ceil(log2(max(1, DIRECTIONS * n)) / 2))
    held = durable(classes.select("group", "d", "node", "v").mapInArrow(_listed(words, similarity), "group long, node long, filter long"))
    keys = ["group", "filter"]
    lengths = durable(held.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1"))
    held = durable(hot_join(held, lengths, keys, "k"))
    balls = _balls(held, classes, similarity)
    found = durable(_links(held, balls, classes, words, similarity))
    edges = found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).union(balls.where("node <> ball").select("node", "ball")).distinct()
    whole = components(edges).select("node", "component")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    ball_rows = classes.select("node", "m").join(balls, "node")
    sums = durable(ball_rows.groupBy("ball").agg(F.sum("m").alias("rows"), F.count("*").alias("c")))
    in_balls = hot_join(durable(ball_rows), sums, ["ball"], "c").select("node", "rows")
    named = classes.select("node", "h1", "h2", "m", "rep").join(counts, "node", "left").join(in_balls, "node", "left").join(whole, "node", "left")
    # all rows of a ball, or of the class, but the row itself, and those linked from outside
    links = F.coalesce("rows", "m") - 1 + F.coalesce("links", F.lit(0))
    named = durable(named.select("h1", "h2", "m", "rep", links.alias("n_links"), F.coalesce("component", "node").alias("component")))
    least = durable(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("c")))
    named = durable(hot_join(named, least, ["component"], "c").select("h1", "h2", "m", "n_links", "component_id"))
    linked = hot_join(light.where("usable"), named, ["h1", "h2"], "m").select("id", "n_links", "component_id")
    alone = light.where(~F.col("usable")).select("id", F.lit(0).cast("long"), "id")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("n_links") == 0)
    result = linked.union(alone).withColumn("kept", kept)
    return result.withColumnRenamed("id", id)


def _balls(held: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(node, ball): vectors within half the angle of the threshold around the pivot of a large filter.

    A pivot is the vector of a filter with the least hash, so the filters of one family elect the same one.
    Each turn elects among the vectors that are in no ball; a vector joins the ball of the least pivot.
    """
    spark = held.sparkSession
    balls = spark.createDataFrame([], "node long, ball long")
    near = min(1.0, cos(acos(similarity) / 2) + SLACK)
    open_rows = held.where(F.col("k") > BLOCK)
    by = F.struct(F.xxhash64("node"), "node")
    for _ in range(TURNS):
        pivots = open_rows.groupBy("group", "filter").agg(F.min(by)["node"].alias("ball"), F.count("*").alias("k")).where(F.col("k") > BLOCK)
        pivots = durable(pivots)
        if pivots.isEmpty():
            break
        asked = hot_join(open_rows.drop("k"), pivots, ["group", "filter"], "k").select("node", "ball").distinct()
        asked = durable(asked)
        sizes = asked.groupBy("ball").agg(F.count("*").alias("c")).join(classes.select(F.col("node").alias("ball"), F.col("v").alias("p")), "ball")
        pairs = hot_join(asked, durable(sizes), ["ball"], "c").join(classes.select("node", "v"), "node")
        product = F.aggregate(F.zip_with("v", "p", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
        close = F.when(F.col("node") == F.col("ball"), True).otherwise(product >= near * length("v") * length("p"))
        joined = pairs.where(close).groupBy("node").agg(F.min(F.struct(F.xxhash64("ball"), "ball"))["ball"].alias("ball"))
        # a pivot that has itself joined another ball leads none
        joined = durable(joined)
        led = joined.where("node = ball").select("ball")
        balls = durable(balls.union(joined.join(led, "ball", "left_semi").select("node", "ball")))
        open_rows = durable(open_rows.join(balls, "node", "left_anti"))
    return balls


def _links(held: DataFrame, balls: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, links, other) of every filter; links with vectors of the same ball are left out."""
    keys = ["group", "filter"]
    rows = held.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1)))
    small = rows.where(F.col("k") <= BLOCK).select(*keys, "node", "ball", *[F.lit(0).alias(c) for c in ("block", "low", "high")])
    large = durable(rows.where(F.col("k") > BLOCK))
    if not large.isEmpty():
        # a large ball has blocks of its own; all others share the rest
        parts = large.groupBy(*keys, "ball").agg(F.count("*").alias("c"))
        own = F.when((F.col("ball") >= 0) & (F.col("c") > BLOCK // 2), F.col("ball")).otherwise(-1)
        parts = parts.withColumn("part", own).groupBy(*keys, "part").agg(F.sum("c").alias("c"))
        parts = parts.withColumn("blocks", F.ceil(F.col("c") / BLOCK))
        every = Window.partitionBy(*keys)
        before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0))).withColumn("all", F.sum("blocks").over(every))
        parts = durable(parts.select(*keys, "part", "c", "blocks", "first", "all"))
        leads = parts.where("part >= 0").select(*keys, F.col("part").alias("ball"), F.lit(True).alias("leads"))
        placed = durable(large.join(leads, [*keys, "ball"], "left").withColumn("part", F.when(F.col("leads"), F.col("ball")).otherwise(-1)).drop("leads"))
        placed = hot_join(placed, parts, [*keys, "part"], "c")
        block = F.col("first") + F.pmod(F.xxhash64("node", "filter"), F.col("blocks"))
        placed = placed.withColumn("block", block.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("all").cast("int") - 1)))
        within = (F.col("part") >= 0) & F.col("other").between(F.col("first"), F.col("first") + F.col("blocks") - 1)
        tiles = placed.where(~within).select(*keys, "node", "ball", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        small = small.union(tiles)
    whole = small.join(classes.select("node", "d", "v", "m"), "node")
    tile = [*keys, "low", "high"]
    return whole.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_verified(words, similarity), "node long, links long, other long")


#: By comparing all pairs of a label; for ids that are unique, as ``embeddings`` has them.
ORACLE_SQL = """
WITH RECURSIVE usable AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM usable UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, coalesce(c.least, e.vec_id) AS component_id, coalesce(c.least, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
