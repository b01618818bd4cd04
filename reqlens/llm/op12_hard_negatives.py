"""Hard-negative mining with anchor spanning-tree bounds (operator 12).

Anchors (every ``EVERY``-th vec_id) meet all rows.  A row's score is its integer
inner product with the anchor; an anchor's positives are its best ``POSITIVES``
other rows of the same label, and each positive's hard negatives are the best
``NEGATIVES`` rows of other labels whose score is 80 to 100 % of the positive's.

1. Rows are packed into blocks, landed once.  Anchors are dealt to blocks so that
   near ones meet (sorted by the signs of fixed projections), and every anchor block
   gets its minimum spanning tree by distance.
2. Blocks of rows and blocks of anchors meet in a grid of bounded cells
   (the stated query set against all rows, in blocks).  In a cell the root anchor is
   scored against all rows; from there, a child's score of a row lies within the
   parent's score plus or minus edge length times the row's norm.  Only
   rows whose interval reaches the window are scored, which makes their interval a
   point; the others hand a wider interval down the tree.
3. First pass, window: not under the fifth best lower bound.  It gives the
   positives.  Second pass, windows: 80 to 100 % of each positive's score.
4. A cell sends the few best rows per anchor (and positive); they are merged by rank.

Every row is covered by a bound or a score, so the result is exact whatever the
tree is worth; on rows far from each other the bounds are wide and most rows are
scored.

Defined cases: rows with a null vec_id, label or vector or with a null or
non-finite component take no part; an empty vector scores 0 and a shorter
one counts as padded with zeros; every row stands for itself, so a repeated row
repeats as anchor, positive and negative, but rows with the anchor's own vec_id
are never its positives; an anchor without positives, or a positive without
negatives, gives no row; a negative positive score has an empty window; ties
go to the smaller vec_id; scores that a long cannot hold raise; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reqlens.llm.common import land, partitions, read_table

#: anchors are rows whose vec_id is divisible by this; RELABEL likewise moves the label on
EVERY, RELABEL, CLASSES = 100, 7, 10
POSITIVES = NEGATIVES = 5
#: a negative's score in percent of the positive's
LOW, HIGH = 80, 100
#: rows of a block; anchors of a block and its tree
ROWS, ANCHORS = 8192, 256
#: blocks of rows and of anchors that meet in one cell of the grid
CELL_ROWS, CELL_ANCHORS = 16, 8
#: products up to here are exact in double precision
EXACT = float(1 << 52)

_BLOCK = "block long, n int, ids binary, labels binary, vectors binary, kind string"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (moved on where the rule says so) and the components as
    doubles, of the rows that take part."""
    label = F.col("label").cast("long")
    return (vectors.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
            .where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
            .where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
            .withColumn("label", F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))))


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(256 x) of a list column, short rows padded with zeros."""
    flat = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False))
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _narrow(m: np.ndarray) -> tuple[str, bytes]:
    """The matrix in the smallest type that holds it."""
    top = np.abs(m).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    return kind, m.astype(kind).tobytes()


def _pack(size: int):
    """Batches of (vec_id, label, embedding, ...) as blocks of ``size`` rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            kind, raw = _narrow(_matrix(table["embedding"].combine_chunks()))
            ids, labels = (table[c].to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label"))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                (number, pa.int64()), (table.num_rows, pa.int32()), (ids, pa.binary()), (labels, pa.binary()), (raw, pa.binary()),
                (kind, pa.string()))], ["block", "n", "ids", "labels", "vectors", "kind"])
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                number, held = number + 1, table.slice(size).to_batches()
                rows -= size
        if rows:
            yield block(pa.Table.from_batches(held))
    return pack


class Block:
    """An unpacked block: ids, labels and vectors (integers held as doubles)."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], -1).astype(float)
        self.norms = np.sqrt((self.vectors ** 2).sum(axis=1)) * (1 + 1e-12)


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree by distance (Prim): anchors in an order in which
    parents come first, the parent of each (-1: root) and the edge lengths,
    which are rounded up."""
    n = len(vectors)
    root = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    order, parent, edge = np.empty(n, np.int64), np.full(n, -1), np.zeros(n)
    best, via, left = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    at = root
    for k in range(n):
        order[k], left[at] = at, False
        d = ((vectors - vectors[at]) ** 2).sum(axis=1)
        nearer = left & (d < best)
        best[nearer], via[nearer] = d[nearer], at
        if k < n - 1:
            at = int(np.argmin(np.where(left, best, np.inf)))
            parent[at], edge[at] = via[at], np.sqrt(best[at]) * (1 + 1e-12)
    return order, parent, edge


class Bounds:
    """Scores of a block of rows at the anchors of a tree, by bounds first.

    ``at(k)`` gives the interval of every row at anchor ``k`` (parents must be
    asked before children); ``score(k, rows)`` scores rows exactly.
    """

    def __init__(self, anchors: Block, tree: tuple, rows: Block):
        width = max(anchors.vectors.shape[1], rows.vectors.shape[1])
        self.a, self.c, self.norms = _padded(anchors.vectors, width), _padded(rows.vectors, width), rows.norms
        _, self.parent, self.edge = tree
        self.exact = anchors.norms.max(initial=0) * rows.norms.max(initial=0) < EXACT
        self.pending = np.bincount(self.parent[self.parent >= 0], minlength=len(self.a))
        self.low, self.high, self.scored = {}, {}, 0

    def at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        p = int(self.parent[k])
        if p < 0 or not self.exact:
            s = self.score(k, np.arange(len(self.c)))
            low = high = s.astype(float) if self.exact else np.array([float(x) for x in s])
            low, high = low.copy(), high.copy()
        else:
            reach = self.edge[k] * self.norms + 0.5       # scores are whole numbers, so half a point is safe for rounding
            low, high = self.low[p] - reach, self.high[p] + reach
            self.pending[p] -= 1
            if not self.pending[p]:
                del self.low[p], self.high[p]
        if self.pending[k]:
            self.low[k], self.high[k] = low, high
        return low, high

    def score(self, k: int, rows: np.ndarray) -> np.ndarray:
        self.scored += len(rows)
        if self.exact:
            return self.c[rows] @ self.a[k]
        own = [int(x) for x in self.a[k]]
        return np.array([sum(x * int(y) for x, y in zip(own, c)) for c in self.c[rows].tolist()], object)

    def settle(self, k: int, rows: np.ndarray, scores: np.ndarray) -> None:
        """Scored rows hand a point, not an interval, to the children."""
        if k in self.low and self.exact:
            self.low[k][rows] = self.high[k][rows] = scores


def _best(found: list, scores: np.ndarray, ids: np.ndarray, k: int) -> list:
    """The k best (score descending, vec_id ascending) of ``found`` and new rows."""
    if len(ids) > k:
        cut = np.partition(scores.astype(float), len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(scores.astype(float) >= cut)
        scores, ids = scores[near], ids[near]
    return nsmallest(k, found + [(-int(s), int(i)) for s, i in zip(scores, ids)])


def _find_positives(b: Bounds, k: int, label: int, own: int, rows: Block, found: list) -> list:
    low, high = b.at(k)
    same = np.flatnonzero((rows.labels == label) & (rows.ids != own))
    if len(same) > POSITIVES:
        floor = np.partition(low[same], len(same) - POSITIVES)[len(same) - POSITIVES]
        same = same[high[same] >= floor]
    if len(found) == POSITIVES:
        same = same[high[same] >= -found[-1][0]]
    scores = b.score(k, same)
    b.settle(k, same, scores)
    return _best(found, scores, rows.ids[same], POSITIVES)


def _find_negatives(b: Bounds, k: int, label: int, wanted: list[int], rows: Block, found: dict) -> None:
    low, high = b.at(k)
    near = np.zeros(len(low), bool)
    for p in set(wanted):
        near |= (100 * high >= LOW * p) & (100 * low <= HIGH * p)
    near = np.flatnonzero(near & (rows.labels != label))
    scores = b.score(k, near)
    b.settle(k, near, scores)
    for place, p in enumerate(wanted, 1):
        inside = (100 * scores >= LOW * p) & (100 * scores <= HIGH * p)
        found[place] = _best(found.get(place, []), scores[inside], rows.ids[near][inside], NEGATIVES)


_FOUND = pa.schema([("block", pa.int64()), ("anchor", pa.int32()), ("anchor_id", pa.int64()), ("place", pa.int32()),
                    ("vec_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "block long, anchor int, anchor_id long, place int, vec_id long, score long"


def _cell(rows: pa.Table, anchors: pa.Table) -> pa.Table:
    """One cell of the grid.  Anchor blocks that carry ``positives`` get hard
    negatives, the others positives."""
    found, blocks = [], [Block(r) for r in rows.to_pylist()]
    for row in anchors.to_pylist():
        own, wanted = Block(row), {}
        for p in row.get("positives") or []:
            wanted.setdefault(p["anchor"], []).append(p["score"])
        tree = tuple(np.frombuffer(row[c], t) for c, t in (("tree", "<i8"), ("parent", "<i8"), ("edge", "<f8")))
        best: dict = {}
        for block in blocks:
            b = Bounds(own, tree, block)
            for k in tree[0].tolist():
                label, vec_id = int(own.labels[k]), int(own.ids[k])
                if "positives" in row:
                    _find_negatives(b, k, label, wanted.get(k, []), block, best.setdefault(k, {}))
                else:
                    best[k] = {0: _find_positives(b, k, label, vec_id, block, best.get(k, {0: []})[0])}
        found += [(row["block"], k, int(own.ids[k]), place, i, -s)
                  for k, places in best.items() for place, rows_ in places.items() for s, i in rows_]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(_FOUND), _FOUND)],
                                schema=_FOUND)


def _numbered(blocks: DataFrame, groups: int, name: str) -> DataFrame:
    return blocks.withColumn(name, F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))


def _meet(rows: DataFrame, anchors: DataFrame, across: int, down: int) -> DataFrame:
    """Every group of row blocks meets every group of anchor blocks."""
    left = _numbered(rows, across, "x").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = _numbered(anchors, down, "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return _cell(a, b)
    return left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(cell, _FOUND_DDL)


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anchor_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Anchors in blocks of at most ``size``, near ones together, with trees."""
    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(2))
            planes = np.random.default_rng(1).standard_normal((16, max(m.shape[1], 1)))[:, :m.shape[1]]
            code = ((m @ planes.T) > 0) @ (1 << np.arange(15, -1, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int32))], [*batch.schema.names, "side"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                order, parent, edge = spanning_tree(Block(row).vectors)
                row |= {"tree": order.astype("<i8").tobytes(), "parent": parent.astype("<i8").tobytes(), "edge": edge.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([*batch.schema, *((c, pa.binary()) for c in ("tree", "parent", "edge"))]))
    chosen = vectors.where(F.col("vec_id") % EVERY == 0)
    n = chosen.count()
    return (chosen.mapInArrow(sides, "vec_id long, label long, embedding array<double>, side int")
            .repartitionByRange(max(1, -(-n // (4 * size))), "side", "vec_id").sortWithinPartitions("side", "vec_id")
            .select("vec_id", "label", "embedding").mapInArrow(_pack(size), _BLOCK)
            .mapInArrow(grow, _BLOCK + ", tree binary, parent binary, edge binary"))


def mine(vectors: DataFrame, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    kept = usable(vectors)
    blocks = land(kept.mapInArrow(_pack(rows), _BLOCK), "vector-blocks")
    trees = land(anchor_blocks(kept, anchors), "anchor-trees")
    n, m = blocks.count(), trees.count()
    across = max(1, min(n, max(partitions(spark), -(-n // CELL_ROWS))))
    down = max(1, -(-m // CELL_ANCHORS))
    positives = land(_ranked(_meet(blocks, trees, across, down), POSITIVES, "block", "anchor")
                     .select("block", "anchor", "anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                             F.col("score").alias("positive_score")), "positives")
    # at most ANCHORS x POSITIVES in a block
    wanted = positives.groupBy("block").agg(F.sort_array(F.collect_list(
        F.struct("anchor", "place", F.col("positive_score").alias("score")))).alias("positives"))
    negatives = _ranked(_meet(blocks, trees.join(wanted, "block"), across, down), NEGATIVES, "block", "anchor", "place")
    return (negatives.select("block", "anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(positives, ["block", "anchor", "place"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r AS ar, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                  CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score
           FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positive AS (SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score,
                    row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS place
             FROM scored WHERE same QUALIFY place <= 5),
negative AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                    row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.vec_id) AS rank
             FROM positive p JOIN scored s ON p.ar = s.ar AND NOT s.same
              AND 100 * s.score BETWEEN 80 * p.positive_score AND 100 * p.positive_score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative
"""
