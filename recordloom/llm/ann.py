"""Approximate nearest neighbours by largest inner product in a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is filed in the leaf that it descends to. A
query walks the tree best bin first: a priority queue holds the nodes seen so far by the inner
product of query and centre, and leaves are visited in the order they leave the queue. How many are
visited is calibrated: a bounded sample of the queries is answered exactly, by one pass over all
vectors, and visits are widened until the leaves hold the wanted share of the exact neighbours. That
is done for the tree cut at each of its levels, and the level with the least work for a query is
taken: vectors without clusters are better filed in few large leaves, clustered ones in many.

Vectors and queries meet in one shuffle on (group, block, part): a group is a coarse node with all leaves
below it, so that a query is sent, and answers, once for a group however many of its leaves it visits. A
group of many vectors is dealt to blocks of bounded size, and a query that visits it goes to each; its
queries are dealt to parts in the same way. Equal vectors are filed once and their ids
are put back into the answers, at most k + 1 smallest for each vector, which is all that a list of k
can hold. What is sent to tasks is the tree, whose size the sample bounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import durable

#: Vectors to fit the tree on, and queries to calibrate on, at most.
SAMPLE, CALIBRATE = 16384, 256
#: Children of a node; vectors of the whole index that a leaf should hold; rows of a block.
BRANCH, LEAF, BLOCK = 8, 512, 16384
#: Candidates beyond k that a block keeps, against rounding in the matrix product.
SPARE = 4
#: Work for a query, in vectors compared: of one more leaf, and of one more group of leaves, to which it is sent
#: and from which its candidates come back.
VISIT, SEND = 16, 256
#: Queries that are compared with a block at once.
ASKED = 128


class Tree:
    """Nodes in order of creation; node 0 is the root; nodes without children are leaves."""

    def __init__(self, sample: np.ndarray, least: int, seed: int = 7):
        centres = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        self.parent, self.depth = [-1], [0]
        rng = np.random.default_rng(seed)
        todo = [(0, sample)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= least:
                continue
            part = _kmeans(rows, BRANCH, rng)
            groups = [g for j in range(BRANCH) if len(g := rows[part == j])]
            if len(groups) < 2:
                continue
            for g in groups:
                self.children[node].append(len(centres))
                todo.append((len(centres), g))
                centres.append(g.mean(0))
                self.children.append([])
                self.parent.append(node)
                self.depth.append(self.depth[node] + 1)
        self.centres = np.array(centres)

    def cut(self, depth: int) -> Tree:
        """The tree with the nodes of this depth as leaves."""
        out = Tree.__new__(Tree)
        out.centres, out.parent, out.depth = self.centres, self.parent, self.depth
        out.children = [kids if d < depth else [] for kids, d in zip(self.children, self.depth)]
        return out

    def at(self, leaf: int, depth: int) -> int:
        """The leaf of the tree cut at ``depth`` that a leaf lies in."""
        while self.depth[leaf] > depth:
            leaf = self.parent[leaf]
        return leaf

    def descend(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child all the way down."""
        at = np.zeros(len(rows), int)
        active = np.arange(len(rows))
        while len(active):
            deeper = []
            for node in np.unique(at[active]):
                kids = np.array(self.children[node], int)
                if len(kids):
                    mine = active[at[active] == node]
                    c = self.centres[kids]
                    at[mine] = kids[np.argmin((c * c).sum(1) - 2 * rows[mine] @ c.T, axis=1)]
                    deeper.append(mine)
            active = np.concatenate(deeper) if deeper else active[:0]
        return at

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        closeness = -(self.centres @ query)
        queue = [(closeness[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield node
            for kid in self.children[node]:
                heapq.heappush(queue, (closeness[kid], kid))


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, turns: int = 12) -> np.ndarray:
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    part = np.zeros(len(rows), int)
    for _ in range(turns):
        part = np.argmin((centres * centres).sum(1) - 2 * rows @ centres.T, axis=1)
        centres = np.array([rows[part == j].mean(0) if (part == j).any() else rows[rng.integers(len(rows))] for j in range(len(centres))])
    return part


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, ties to smaller ids."""
    if len(scores) > 4 * k:
        few = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        few = np.arange(len(scores))
    return few[np.lexsort((ids[few], -scores[few]))[:k]]


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def neighbours(
    vectors: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.97
) -> DataFrame:
    """(query_id, rank, vec_id, score, recall): the k nearest found of each row that ``queries`` marks.

    A row's candidates are all rows but those of its own id; nearest is the largest inner product in
    double precision, ties go to smaller ids; fewer candidates give all of them. Rows without an id
    and vectors that are null, empty, zero or hold nulls or non-finite numbers take no part, nor do
    vectors of another length than most have. Rows that repeat id and vector count once. Other
    columns play no part. ``recall`` is what was measured for the sampled queries: the share of their
    exact neighbours that lie in the leaves visited; 1 where no query was sampled.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v")))
    spark = vectors.sparkSession
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double")
    d = lengths["d"]
    rows = rows.where(F.size("v") == d)
    # equal vectors: one is filed; at most k + 1 ids of each can be in an answer
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = rows.select("id", "v").distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    members = durable(members.withColumn("rep", F.min("id").over(Window.partitionBy("v"))))
    filed = members.where("nth = 1").select("id", "v")
    asked = durable(rows.where("asks").select(F.col("id").alias("q"), "v").distinct())
    n = filed.count()
    sample = filed.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    sampled = _matrix(sample.column("v"), d)
    deep = Tree(sampled, max(8, LEAF * len(sampled) // max(n, 1)))
    shipped_deep = spark.sparkContext.broadcast(deep)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shipped_deep.value.descend(_matrix(batch.column("v"), d)) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(leaf, pa.int32())], ["id", "v", "leaf"])

    placed = durable(filed.mapInArrow(place, "id long, v array<double>, leaf int"))
    counted = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf of the tree
    # leaves are shuffled in groups, the coarsest nodes that a block may hold
    coarse = next((c for c in range(1, max(deep.depth) + 1) if n <= BLOCK * BRANCH**c), max(1, *deep.depth, 1))
    level, width, measured = _calibrated(placed, asked, deep, counted, d, k, recall, coarse)
    sizes: dict[int, int] = {}  # vectors of each leaf, and of each group of leaves
    whole: dict[int, int] = {}
    for leaf, count in counted.items():
        for held, depth in ((sizes, level), (whole, min(coarse, level))):
            held[deep.at(leaf, depth)] = held.get(deep.at(leaf, depth), 0) + count
    shipped = spark.sparkContext.broadcast(deep.cut(level))
    above = lambda depth: F.split(F.lit(",".join(str(deep.at(i, depth)) for i in range(len(deep.parent)))), ",").cast("array<int>")[F.col("leaf")]
    placed = placed.select("id", "v", above(level).alias("leaf"), above(min(coarse, level)).alias("g"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for batch in batches:
            take, groups, blocks, lists = [], [], [], []
            for i, q in enumerate(_matrix(batch.column("v"), d) if len(batch) else ()):
                held, wanted = 0, {}
                for seen, leaf in enumerate(t.visits(q), 1):
                    wanted.setdefault(t.at(leaf, coarse), []).append(leaf)
                    held += sizes.get(leaf, 0)
                    if seen >= width and held > 2 * k:
                        break
                for g, leaves in wanted.items():
                    parts = -(-whole.get(g, 0) // BLOCK)
                    take += [i] * parts
                    groups += [g] * parts
                    blocks += range(parts)
                    lists += [leaves] * parts
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("q"), part.column("v"), pa.array(groups, pa.int32()), pa.array(blocks, pa.int32()), pa.array(lists, pa.list_(pa.int32()))],
                ["q", "v", "g", "block", "leaves"],
            )

    def meet(ask: pa.Table, have: pa.Table) -> pa.Table:
        if not len(ask) or not len(have):
            return pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, v = _matrix(ask.column("v"), d), _matrix(have.column("v"), d)
        ids, names, leaf = have.column("id").to_numpy(), ask.column("q").to_numpy(), have.column("leaf").to_numpy()
        lists = ask.column("leaves").combine_chunks()
        asker = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
        asked_leaf = lists.flatten().to_numpy()
        found, most = [], k + 1 + SPARE
        for one in np.unique(leaf):
            mine, asking = np.flatnonzero(leaf == one), asker[asked_leaf == one]
            for a in range(0, len(asking), ASKED):
                part = asking[a : a + ASKED]
                scores = q[part] @ v[mine].T
                if len(mine) > most:  # ties with the last one come along
                    asks, has = np.nonzero(scores >= np.partition(scores, -most, axis=1)[:, -most, None])
                else:
                    asks, has = np.nonzero(np.ones_like(scores, bool))
                found.append((part[asks], mine[has], scores[asks, has]))
        if not found:
            return meet(ask.slice(0, 0), have)
        asks, has, scores = (np.concatenate(x) for x in zip(*found))
        # of all leaves of the group a query keeps the best, and what ties with the last of them
        order = np.lexsort((-scores, asks))
        asks, has, scores = asks[order], has[order], scores[order]
        first = np.flatnonzero(np.append(True, asks[1:] != asks[:-1]))
        counts = np.diff(np.append(first, len(asks)))
        last = scores[first + np.minimum(counts, most) - 1]
        kept = scores >= np.repeat(last, counts)
        asks, has = asks[kept], has[kept]
        exact = (q[asks] * v[has]).sum(1)  # summed alike wherever the vector stands
        return pa.table({"q": names[asks], "id": ids[has], "score": exact})

    asking = durable(asked.mapInArrow(visit, "q long, v array<double>, g int, block int, leaves array<int>"))
    # a row for each group of the tree: queries of a group are dealt to parts, and its vectors go to each
    many = {r["g"]: -(-r["count"] // BLOCK) for r in asking.where("block = 0").groupBy("g").count().collect()}
    of = lambda numbers: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for item in numbers.items() for x in item]), F.col("g")), F.lit(1)) if numbers else F.lit(1)
    queried = {g: n for g, n in many.items() if n > 1}
    blocked = {g: -(-n // BLOCK) for g, n in whole.items() if n > BLOCK}
    asking = asking.withColumn("part", F.pmod(F.xxhash64("q"), of(queried)).cast("int"))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("id"), of(blocked)).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), of(queried) - 1)))
    found = asking.groupBy("g", "block", "part").cogroup(dealt.groupBy("g", "block", "part")).applyInArrow(meet, "q long, id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    copies = members.where("nth > 1").select("rep", F.col("id").alias("copy"))
    more = best.join(copies, best["id"] == copies["rep"]).select("q", F.col("copy").alias("id"), "score")
    answers = best.select("q", "id", "score").union(more).where("q <> id")
    return (
        answers.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("q").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score", F.lit(measured).alias("recall"))
    )


def _calibrated(
    placed: DataFrame, asked: DataFrame, tree: Tree, sizes: dict[int, int], d: int, k: int, recall: float, coarse: int
) -> tuple[int, int, float]:
    """The level to cut the tree at, how many leaves to visit there, and the recall of the sampled queries.

    At each level visits are widened until the sampled queries' exact neighbours are found.
    """
    rows = asked.orderBy(F.xxhash64("q", F.lit(3)), "q").limit(CALIBRATE).toArrow()
    if not len(rows):
        return 1, 1, 1.0
    queries, names = _matrix(rows.column("v"), d), rows.column("q").to_numpy()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            scores = queries @ _matrix(batch.column("v"), d).T
            ids, leaves = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            for i, own in enumerate(names):
                best = _top(np.where(ids == own, -np.inf, scores[i]), ids, k)
                best = best[ids[best] != own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), i)), pa.array(ids[best]), pa.array(leaves[best]), pa.array(scores[i][best])], ["i", "id", "leaf", "score"]
                )

    near = placed.mapInArrow(exact, "i long, id long, leaf int, score double")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "id")
    truth = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("i", "leaf").collect()
    best = (np.inf, 1, 1, 1.0)
    for level in range(1, max(1, *tree.depth) + 1 if len(tree.depth) > 1 else 2):
        cut, held = tree.cut(level), {}
        for leaf, count in sizes.items():
            held[tree.at(leaf, level)] = held.get(tree.at(leaf, level), 0) + count
        orders = [list(cut.visits(q)) for q in queries]
        ranks = [{leaf: r for r, leaf in enumerate(o, 1)} for o in orders]
        needed = np.array([ranks[t["i"]][tree.at(t["leaf"], level)] for t in truth])
        width = 1
        while len(needed) and (needed <= width).mean() < recall:
            width += 1
        scanned = np.mean([sum(held.get(leaf, 0) for leaf in o[:width]) for o in orders])
        reached = float((needed <= width).mean()) if len(needed) else 1.0
        groups = np.mean([len({cut.at(leaf, coarse) for leaf in o[:width]}) for o in orders])
        best = min(best, (scanned + VISIT * width + SEND * groups, level, width, reached))
    return best[1:]
