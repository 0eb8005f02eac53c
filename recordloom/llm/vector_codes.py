"""Vector codes by filtering Lloyd: each part of a vector becomes the index of its nearest codebook entry.

Vectors are made integers and cut into equal parts; each part position has a codebook, refined by Lloyd's
rounds. Every task gathers its vectors in blocks and builds a kd-tree over each part of a block, whose nodes
keep the bounding box, the sum and (by their place) the count of their rows. The trees are written once, and each round
walks them level by level: of the entries still considered at a node, those that lie farther than the
entry nearest to the middle of its box from every place of the box are eliminated; where one is
left, the whole subtree is its, by the cached sum and count. What is left at the leaves is compared one by one.

All arithmetic is on integers (in doubles only where they are exact), so sums do not depend on the order
of rows or the number of tasks. Tasks send a sum for each entry and component; what reaches the driver
and goes back is the codebooks, whose size the vectors' length sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from recordloom.llm.common import durable, finite, hot_join, matrix, tidied

#: Components of a block of vectors; rows of a leaf at most.
COMPONENTS, LEAF = 1 << 18, 32
#: Doubles are exact below this.
EXACT = 1 << 53
_TREE = "array<struct<order: binary, points: binary, low: binary, high: binary, sums: binary>>"


class Tree:
    """A kd-tree over the rows of ``points``, complete: node k of level l holds the places from n k / 2^l on.

    ``points`` are in the tree's order, ``order`` says where they were. ``low``, ``high`` and ``sums``
    have a row for each node, level by level.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.depth = depth = max(0, (max(n - 1, 0) // LEAF).bit_length())
        order = np.arange(n)
        for level in range(depth):
            edges = self.edges(n, level)
            middles = self.edges(n, level + 1)[1::2]
            for start, middle, end in zip(edges, middles, edges[1:]):
                rows = points[order[start:end]]
                widest = np.argmax(rows.max(0) - rows.min(0))
                order[start:end] = order[start:end][np.argpartition(rows[:, widest], middle - start)]
        self.order, self.points = order, points[order]
        levels = [(self.edges(n, level)[:-1]) for level in range(depth + 1)]
        over = lambda f: np.concatenate([f.reduceat(self.points, starts) for starts in levels])
        self.low, self.high, self.sums = over(np.minimum), over(np.maximum), over(np.add)

    @staticmethod
    def edges(n: int, level: int) -> np.ndarray:
        return n * np.arange((1 << level) + 1) >> level

    def stored(self) -> dict[str, bytes]:
        return {
            "order": self.order.astype("<i4").tobytes(), "points": self.points.astype("<i4").tobytes(),
            "low": self.low.astype("<i4").tobytes(), "high": self.high.astype("<i4").tobytes(), "sums": self.sums.astype("<i8").tobytes(),
        }

    @classmethod
    def read(cls, row: dict[str, bytes], width: int) -> Tree:
        out = cls.__new__(cls)
        number = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
        out.order = number("order", "<i4")
        out.points, out.low, out.high = (number(name, "<i4").reshape(-1, width) for name in ("points", "low", "high"))
        out.sums = number("sums", "<i8").reshape(-1, width)
        out.depth = (max(len(out.order) - 1, 0) // LEAF).bit_length()
        return out

    def assigned(self, entries: np.ndarray) -> Iterator[tuple[int, int, int | np.ndarray, np.ndarray | None]]:
        """(start, end, entry, sum): places whose nearest entry is known, as a subtree with its sum or place by place."""
        n, k = len(self.points), len(entries)
        # squared distances to twice the middle of a box stay below 4 width (2 largest)^2
        largest = max(int(np.abs(self.points).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
        kind = float if 32 * self.points.shape[1] * largest * largest < EXACT else np.int64
        z = entries.astype(kind)
        squares = (z * z).sum(1)
        node, mask = np.zeros(1, int), np.ones((1, k), bool)
        for level in range(self.depth + 1):
            if not len(node):
                return
            base = (1 << level) - 1
            low, high = self.low[base + node].astype(kind), self.high[base + node].astype(kind)
            closeness = 4 * squares - 4 * (low + high) @ z.T
            best = np.argmin(np.where(mask, closeness, closeness.max() + 1), axis=1)
            mask[np.arange(len(node)), best] = False
            at, entry = np.nonzero(mask)
            mask[np.arange(len(node)), best] = True
            u = z[entry] - z[best[at]]
            # the least of |p - z|^2 - |p - best|^2 over the places p of the box
            least = squares[entry] - squares[best[at]] - 2 * (np.maximum(u, 0) * high[at] + np.minimum(u, 0) * low[at]).sum(1)
            gone = (least > 0) | (least == 0) & (entry > best[at])
            mask[at[gone], entry[gone]] = False
            edges = self.edges(n, level)
            alone = mask.sum(1) == 1
            for i in np.flatnonzero(alone):
                yield edges[node[i]], edges[node[i] + 1], int(best[i]), self.sums[base + node[i]]
            node, mask = node[~alone], mask[~alone]
            if level < self.depth:
                node, mask = np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(mask, 2, axis=0)
        for i, m in zip(node, mask):
            start, end, few = edges[i], edges[i + 1], np.flatnonzero(m)
            distances = squares[few] - 2 * self.points[start:end].astype(kind) @ z[few].T
            yield start, end, few[np.argmin(distances, axis=1)], None


def _blocks(width: int, parts: int, scale: int):
    """Vectors as blocks: ids, labels and a tree for each part."""
    size = max(LEAF, COMPONENTS // max(width * parts, 1))

    def block(ids: list, labels: list, vectors: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        whole = np.concatenate(vectors)
        trees = [Tree(np.ascontiguousarray(whole[:, p * width : (p + 1) * width])).stored() for p in range(parts)]
        columns = [pa.array([sum((x.to_pylist() for x in ids), [])], schema.field(0).type), pa.array([sum((x.to_pylist() for x in labels), [])], schema.field(1).type), pa.array([trees], schema.field(2).type)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    @tidied
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, held, schema = [], [], [], 0, None
        tree = pa.list_(pa.struct([(name, pa.binary()) for name in ("order", "points", "low", "high", "sums")]))
        for batch in batches:
            schema = pa.schema([("ids", pa.list_(batch.schema.field(0).type)), ("labels", pa.list_(batch.schema.field(1).type)), ("trees", tree)])
            for start in range(0, len(batch), size):
                some = batch.slice(start, size)
                ints = np.floor(scale * matrix(some.column("v"))).astype(np.int64)
                ints = np.pad(ints, ((0, 0), (0, width * parts - ints.shape[1])))
                ids, labels, vectors, held = [*ids, some.column("id")], [*labels, some.column("label")], [*vectors, ints], held + len(some)
                if held >= size:
                    yield block(ids, labels, vectors, schema)
                    ids, labels, vectors, held = [], [], [], 0
        if held:
            yield block(ids, labels, vectors, schema)

    return build


def _moved(books: np.ndarray):
    """Of a task: the sum of each component of an entry's parts, and their count in place -1."""
    parts, entries, width = books.shape

    @tidied
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for trees in batch.column("trees").to_pylist():
                for part, row in enumerate(trees):
                    tree, mine = Tree.read(row, width), total[part]
                    for start, end, entry, whole in tree.assigned(books[part]):
                        if whole is None:
                            np.add.at(mine[:, 1:], entry, tree.points[start:end])
                            mine[:, 0] += np.bincount(entry, minlength=entries)
                        else:
                            mine[entry, 1:] += whole
                            mine[entry, 0] += end - start
        p, e = np.nonzero(total[:, :, 0])
        at = np.tile(np.arange(-1, width, dtype=np.int32), len(p))
        columns = [pa.array(np.repeat(x, width + 1).astype(np.int32)) for x in (p, e)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(total[p, e].ravel())], ["part", "entry", "place", "s"])

    return move


def _coded(books: np.ndarray):
    """Id, label, code and error of each vector of a block."""
    parts, _, width = books.shape

    @tidied
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, trees in enumerate(batch.column("trees").to_pylist()):
                codes, errors = [], 0
                for part, row in enumerate(trees):
                    tree = Tree.read(row, width)
                    nearest = np.zeros(len(tree.order), int)
                    for start, end, entry, _ in tree.assigned(books[part]):
                        nearest[start:end] = entry
                    off = ((tree.points - books[part][nearest]) ** 2).sum(1)
                    found = np.zeros((2, len(nearest)), np.int64)
                    found[:, tree.order] = nearest, off
                    codes.append(found[0])
                    errors = errors + found[1]
                text = ["".join(f"{x:02x}" for x in row) for row in zip(*(c.tolist() for c in codes))]
                ids, labels = (batch.column(name).slice(i, 1).flatten() for name in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), pa.array(errors)], ["id", "label", "code", "error"])

    return code


def compress(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4,
    scale: int = 1024,
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error), and the codebooks as an array (part, entry, component).

    A component x becomes floor(``scale`` * x). Codebooks start as the parts of the ``entries`` smallest ids
    (nulls last, ties by the vector; fewer vectors give fewer entries) and move ``rounds`` times to the floored mean
    of their parts; unused entries stay. ``code`` has two hex digits a part. Vectors that are null or
    empty or hold nulls or non-finite numbers take no part, nor do those of another length than most (of several such
    lengths, the least) and those so large that their squared distances would not fit 63 bits. A length that
    ``parts`` does not divide is filled up with zeros. Repeated ids are coded each. No vectors give no rows
    and empty codebooks. Other columns play no part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths["d"] if lengths else 0
    width = -(-d // parts)
    largest = isqrt((1 << 57) // max(width * parts, 1))
    largest = min(largest, (1 << 31) - 1)
    rows = rows.where((F.size("v") == d) & F.forall("v", lambda x: F.abs(x) * scale < largest))
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow().column("v")
    start = np.floor(scale * matrix(first)).astype(np.int64) if len(first) else np.zeros((0, d), np.int64)
    start = np.pad(start, ((0, 0), (0, width * parts - d)))
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    kinds = rows.select("id", "label").schema
    schema = StructType([StructField("ids", ArrayType(kinds["id"].dataType)), StructField("labels", ArrayType(kinds["label"].dataType))])
    schema = StructType([*schema.fields, *StructType.fromDDL(f"trees {_TREE}").fields])
    blocks = durable(rows.mapInArrow(_blocks(width, parts, scale), schema))
    for _ in range(rounds if len(start) else 0):
        moved = blocks.select("trees").mapInArrow(_moved(books), "part int, entry int, place int, s long")
        found = moved.groupBy("part", "entry", "place").agg(F.sum("s").alias("s")).toArrow()
        part, entry, place, s = (found.column(c).to_numpy() for c in ("part", "entry", "place", "s"))
        total = np.zeros((parts, len(start), width + 1), np.int64)
        total[part, entry, place + 1] = s
        used = total[:, :, 0] > 0
        books[used] = total[used][:, 1:] // total[used][:, :1]
    out = StructType([StructField("id", kinds["id"].dataType), StructField("label", kinds["label"].dataType), StructField("code", StringType()), StructField("error", LongType())])
    coded = blocks.mapInArrow(_coded(books), out)
    return coded.withColumnsRenamed({"id": id, "label": label}), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the components in decimal by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels; nulls are one label, however many rows it has."""
    rows = durable(coded.withColumns({"__known": F.col(label).isNotNull(), "__label": F.coalesce(F.col(label).cast("string"), F.lit(""))}))
    keys = ["__known", "__label"]
    sums = durable(rows.groupBy(*keys).agg(F.sum("error").alias("label_error"), F.count("*").alias("__m")))
    return hot_join(rows, sums, keys, "__m").drop(*keys, "__m")


def _assign(books: str, what: str) -> str:
    """SQL of each part's nearest entry in ``books``; in doubles, which are exact for components of this size."""
    return f"""(SELECT p.vec_id, p.part, min(struct_pack(d := list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), e := b.entry)) AS near
    FROM parts p JOIN {books} b ON p.part = b.part GROUP BY p.vec_id, p.part) {what}"""


def _round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT * FROM {_assign(f"b{i}", "n")}),
m{i} AS MATERIALIZED (SELECT part, entry, list(CAST(floor(s / c) AS DOUBLE) ORDER BY place) AS x FROM (
  SELECT part, near.e AS entry, place, sum(x[place]) AS s, count(*) AS c FROM (
    SELECT a.part, a.near, p.x, unnest(range(1, len(p.x) + 1)) AS place FROM a{i} a JOIN parts p ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry)"""


#: For ids that are unique and vectors of one length, as ``embeddings`` has them.
ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v, len(embedding) // 4 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, p AS part, list_slice(v, p * w + 1, (p + 1) * w) AS x FROM kept, range(4) r(p)),
b0 AS MATERIALIZED (SELECT part, x, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS entry FROM parts QUALIFY entry < 256),
{", ".join(_round(i) for i in range(4))},
last AS MATERIALIZED (SELECT * FROM {_assign("b4", "n")}),
coded AS (SELECT l.vec_id, k.label, string_agg(printf('%02x', near.e), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error
  FROM last l JOIN kept k ON l.vec_id = k.vec_id GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string([CAST(CAST(y AS BIGINT) AS VARCHAR) for y in x], ','), ',' ORDER BY part, entry)) FROM b4) AS codebooks_sha256
FROM coded
"""
