"""Exact top-k by inner product: a KD-tree for each shard, searched best-first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a shard, about, and queries that are searched for at a time in it.
SHARD_ROWS, BLOCK_ROWS = 16384, 512
LEAF_ROWS = 64
#: Components are scaled by this and floored.
SCALE = 256


@dataclass
class Tree:
    """Rows ordered so that each node is a run of them, with the tight box around it."""

    points: np.ndarray
    ids: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    run: list[tuple[int, int]]
    children: list[tuple[int, int] | None]


def build(points: np.ndarray, ids: np.ndarray) -> Tree:
    """Splits at the median of the widest side until LEAF_ROWS are left, or all rows are equal."""
    order = np.arange(len(points))
    lo, hi, run, children = [], [], [], []
    todo = [(0, len(points), -1, 0)] if len(points) else []
    while todo:
        a, b, parent, side = todo.pop()
        me, rows = len(run), points[order[a:b]]
        lo.append(rows.min(axis=0))
        hi.append(rows.max(axis=0))
        run.append((a, b))
        children.append(None)
        if parent >= 0:
            children[parent][side] = me
        wide = hi[-1] - lo[-1]
        if b - a > LEAF_ROWS and wide.max() > 0:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, wide.argmax()], mid)]
            children[me] = [-1, -1]
            todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
    return Tree(points[order], ids[order], np.array(lo), np.array(hi), run, children)


#: Whole numbers are multiplied in limbs of so many bits where doubles would not hold their products' sums.
LIMB_BITS = 20


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as sums of limbs of LIMB_BITS bits, the lowest first, each with its number's sign."""
    left, out = np.abs(x), []
    while True:
        high = np.floor(left * 2.0**-LIMB_BITS)
        out.append(np.copysign(left - high * 2.0**LIMB_BITS, x))
        left = high
        if not left.any():
            return out


def products(points: list[np.ndarray], query: list[np.ndarray]) -> np.ndarray:
    """Exact scores: doubles if one limb each is enough, else Python's whole numbers; what 64 bits cannot hold is the nearest that they can."""
    if len(points) == len(query) == 1:
        return points[0] @ query[0]
    total = np.zeros(len(points[0]), dtype=object)
    for i, p in enumerate(points):
        for j, q in enumerate(query):
            total += (p @ q).astype(np.int64).astype(object) << LIMB_BITS * (i + j)
    return np.maximum(np.minimum(total, (1 << 63) - 1), -(1 << 63))


def search(tree: Tree, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, opened: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query row, score, id) of the best k of each query; ``floor`` is a kth score known from elsewhere (or -inf).

    ``opened``, if given, gets how many leaves have been read for each query.
    """
    out: list[tuple[int, int, int]] = []
    if not len(queries) or not tree.run:
        return out
    dim, small = tree.points.shape[1], float(np.abs(tree.points).max()) * float(np.abs(queries).max()) * tree.points.shape[1] < 2.0**52
    held = [tree.points] if small else limbs(tree.points)
    asked = [queries] if small else limbs(queries)
    # the most that any point of a box can score, for all queries and boxes at once; a little more where doubles round
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = np.maximum(queries, 0) @ tree.hi.T + np.minimum(queries, 0) @ tree.lo.T
        if not small:
            bounds = bounds + 1e-14 * dim * (np.abs(queries) @ np.maximum(np.abs(tree.hi), np.abs(tree.lo)).T) + 1
    bounds[np.isnan(bounds)] = np.inf  # beyond what doubles tell
    for row, (me, least) in enumerate(zip(own, floor)):
        best: list[tuple[float, int]] = []
        bound, kth, leaves = bounds[row], least if small else least - abs(least) * 1e-15, 0
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= kth:  # at the kth score itself a smaller id may still win
            node = heapq.heappop(heap)[1]
            if tree.children[node]:
                for child in tree.children[node]:
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = tree.run[node]
            leaves += 1
            scores, ids = products([p[a:b] for p in held], [q[row] for q in asked]), tree.ids[a:b]
            for i in np.flatnonzero((scores >= kth) & (ids != me)):
                best.append((-scores[i], ids[i]))
            if len(best) >= k:
                best = heapq.nsmallest(k, best)
                kth = max(kth, -best[-1][0])
        out += [(row, int(-s), int(i)) for s, i in heapq.nsmallest(k, best)]
        if opened is not None:
            opened.append(leaves)
    return out


def usable(vector: str) -> Column:
    """Neither null nor empty, nor with a null or non-finite component."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & ok, F.lit(False))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Scaled and floored; a component that a double cannot hold any more when scaled stays as large as that."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
    return np.floor(np.clip(x, -np.finfo(float).max / SCALE, np.finfo(float).max / SCALE) * SCALE)


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """Candidates of each query in each shard that it is sent to. A task builds a shard's tree from its points, which come first, and then takes the queries some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, waiting = None, None, []
        for b in batches:
            where = list(zip(*(b.column(i).to_pylist() for i in range(2))))
            asks = b.column(2).to_numpy(zero_copy_only=False)
            cut = [0, *(i for i in range(1, b.num_rows) if where[i] != where[i - 1] or asks[i] != asks[i - 1]), b.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                if hi == lo:
                    continue
                part = b.slice(lo, hi - lo)
                if where[lo] != now:
                    now, tree, waiting = where[lo], None, []
                points, ids = _matrix(part.column(4), hi - lo), part.column(3).to_numpy()
                if not asks[lo]:
                    waiting.append((points, ids))
                    continue
                if tree is None and waiting:
                    tree = build(np.concatenate([p for p, _ in waiting]), np.concatenate([i for _, i in waiting]))
                    waiting = []
                if tree is None:
                    continue
                floor = part.column(5).to_numpy().astype(np.float64)
                for at in range(0, hi - lo, BLOCK_ROWS):
                    some = slice(at, at + BLOCK_ROWS)
                    if found := search(tree, points[some], ids[some], floor[some], k):
                        row, score, vec = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some][list(row)]), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    wanted = rows.select("dim", "shard", "asks", "id", "v", "floor")
    dealt = wanted.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of highest score for each row for which ``is_query`` holds.

    Components are scaled and floored, and a score is their exact integer inner product; ties go to
    the smaller id. Rows are dealt to shards of bounded size by hash. A shard's KD-tree is built once, and queries
    go through it some at a time, best-first by the most that a box can score. Shards are searched in rounds, one, one, two,
    four and so on, and each round knows the kth scores of those before. Memory of a task: one shard and some queries.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with
    a null key; vectors of another length than the query's are no candidates. A row is never its own
    candidate, nor are rows with its key. Rows that repeat are candidates each. No rows or fewer
    than k: as many as there are. A score that 64 bits cannot hold counts as the nearest that they can.
    Other columns do not matter.
    """
    rows = vectors.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumn("dim", F.size("v"))
    rows = materialize(rows.withColumn("floor", F.lit(float("-inf"))), "topk-vectors")
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    points = rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))
    asked = rows.where("asks")
    found, at, many = None, 0, 1
    while at < shards:
        until = min(shards, at + many)
        told = asked
        if found is not None:
            kth = found.where(F.col("rank") == k).groupBy(F.col("query_id").alias("id")).agg(F.max("score").cast("double").alias("known"))
            told = asked.join(kth, "id", "left").withColumn("floor", F.coalesce("known", "floor")).select(*asked.columns)
        sent = points.where(F.col("shard").between(at, until - 1)).unionByName(told.withColumn("shard", F.explode(F.sequence(F.lit(at), F.lit(until - 1)))))
        new = _searched(sent, k)
        new = new if found is None else found.drop("rank").unionByName(new)
        at, many = until, until
        found = materialize(_best(new, k), "topk-found") if at < shards else _best(new, k)
    return found.select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 50 = 0 AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
