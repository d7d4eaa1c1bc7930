"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits at the median of a projection on the difference of two random points; the forest
is grown in numpy on a bounded sample and sent to every task, so its size does not grow with the
table. A query walks all trees through one shared priority queue, ordered by the smallest margin on
the way, until the leaves it has reached hold enough of the sample. How much is enough is measured:
some rows of the sample are searched among the others, and the least reach that finds TARGET of
their true neighbours is taken, at every size of the table. Rows and queries meet by tree and leaf,
split into blocks of bounded size, and candidates are ranked by their exact distance.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Rows that the forest is grown on at most, its trees, the table's rows that a leaf should hold, and the sample's rows that it holds at least.
SAMPLE_ROWS, TREES, LEAF_ROWS, LEAST_SAMPLE_ROWS = 20_000, 3, 1024, 16
#: Share of the true neighbours that the reach is set to find, and rows of the sample that are searched for it.
TARGET, CALIBRATED = 0.96, 200
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


class Tree:
    """Inner nodes in arrays: a direction, a threshold and two children, a leaf being minus its number minus 1."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator, leaf_rows: int):
        self.direction, self.threshold, self.child, self.leaf_size = [], [], [], []
        self._grow(points, rng, leaf_rows)
        dim = points.shape[1]
        self.direction = np.array(self.direction, np.float32).reshape(-1, dim)
        self.threshold, self.child = np.array(self.threshold), np.array(self.child, np.int64).reshape(-1, 2)

    def _leaf(self, n: int) -> int:
        self.leaf_size.append(n)
        return -len(self.leaf_size)

    def _grow(self, points: np.ndarray, rng: np.random.Generator, leaf_rows: int) -> int:
        if len(points) <= leaf_rows:
            return self._leaf(len(points))
        for _ in range(4):
            a, b = points[rng.choice(len(points), 2, replace=False)]
            direction = a - b
            norm = np.linalg.norm(direction)
            if norm > 0:
                break
        else:
            return self._leaf(len(points))  # copies of one point
        direction = (direction / norm).astype(np.float32)
        side = points @ direction
        threshold = float(np.median(side))
        low = side <= threshold
        if low.all():
            return self._leaf(len(points))
        at = len(self.direction)
        self.direction.append(direction), self.threshold.append(threshold), self.child.append([0, 0])
        self.child[at] = [self._grow(points[low], rng, leaf_rows), self._grow(points[~low], rng, leaf_rows)]
        return at

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        if not len(self.direction):
            return np.zeros(len(points), np.int64)
        node, todo = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(todo):
            at = node[todo]
            high = np.einsum("ij,ij->i", points[todo], self.direction[at]) > self.threshold[at]
            node[todo] = self.child[at, high.astype(int)]
            todo = todo[node[todo] >= 0]
        return -node - 1


def reach(trees: list[Tree], margins: list[np.ndarray], enough: float) -> list[tuple[int, int]]:
    """Tree and leaf of the leaves nearest to a query, until they hold `enough` rows of the sample.

    margins: for each tree the query's projection less the threshold at every inner node.
    """
    queue = [(-np.inf, t, 0 if len(tree.direction) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    found, held = [], 0
    while queue and held < enough:
        worst, t, node = heapq.heappop(queue)
        tree = trees[t]
        while node >= 0:
            m = margins[t][node]
            near, far = (tree.child[node][1], tree.child[node][0]) if m > 0 else (tree.child[node][0], tree.child[node][1])
            heapq.heappush(queue, (max(worst, abs(m)), t, far))
            node = near
        found.append((t, -node - 1))
        held += tree.leaf_size[-node - 1]
    return found


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    flat = np.asarray(column.flatten(), kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vector: str) -> F.Column:
    """Whether a vector takes part: not null or empty, without null, NaN or infinite components, and not all zero."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def sampled(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> np.ndarray:
    """The vectors of at most `sample_rows` rows (id, vector), taken in hash order."""
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select("id", "vector").toArrow()
    return _matrix(picked.sort_by("id").combine_chunks().column("vector").chunk(0)) if picked.num_rows else np.zeros((0, 1), np.float32)


def forest(points: np.ndarray, table_rows: int, trees: int = TREES, seed: int = 5) -> list[Tree]:
    """Trees whose leaves are as small as the table asks for and the sample allows."""
    leaf_rows = max(LEAST_SAMPLE_ROWS, len(points) * LEAF_ROWS // max(1, table_rows))
    rng = np.random.default_rng(seed)
    return [Tree(points, rng, leaf_rows) for _ in range(trees)]


def _sides(trees: list[Tree], points: np.ndarray) -> list[np.ndarray]:
    return [points @ t.direction.T - t.threshold if len(t.direction) else np.zeros((len(points), 0)) for t in trees]


def calibrated(trees: list[Tree], points: np.ndarray, k: int, seed: int = 5) -> float:
    """Rows of the sample that the leaves of a query have to hold, over all trees, to find TARGET of its k nearest ones there."""
    n = len(points)
    if n <= k + 1:
        return np.inf
    asked = np.random.default_rng(seed).choice(n, min(CALIBRATED, n), replace=False)
    near = (points**2).sum(axis=1) - 2 * points[asked] @ points.T
    near[np.arange(len(asked)), asked] = np.inf
    true = np.argpartition(near, k - 1, axis=1)[:, :k]
    leaves, sides = np.stack([t.route(points) for t in trees]), _sides(trees, points[asked])
    held = []  # for each true neighbour the rows held by the leaves up to the first one with it
    for i, own in enumerate(true):
        sums, first = 0, np.full(k, np.inf)
        for t, leaf in reach(trees, [s[i] for s in sides], np.inf):
            sums += trees[t].leaf_size[leaf]
            hit = (leaves[t, own] == leaf) & np.isinf(first)
            first[hit] = sums
            if np.isfinite(first).all():
                break
        held.append(first)
    return float(np.quantile(np.concatenate(held), TARGET))


def search(rows: DataFrame, queries: DataFrame, k: int = 10, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: for each query its k nearest rows but itself, as far as they are found.

    rows and queries are tables (id long, vector array<float>); only vectors of the most frequent
    length take part, and of those only usable ones: null, empty, zero and not finite vectors and null
    ids have no result. Ties go to the smaller id; rows that share an id are one candidate, the
    nearest of them. Queries without any other row have no result; with fewer than k other ids,
    they get all. A query that the leaves give fewer than k ids is compared with every row. Empty tables give an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    rows, queries = (x.where(F.col("id").isNotNull() & usable("vector")) for x in (rows, queries))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    kind = "query_id long, vec_id long, score double"
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, queries = (x.where(F.size("vector") == length[0]["n"]) for x in (rows, queries))
    points = sampled(rows, seed=seed)
    n_rows, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    trees = forest(points, n_rows, seed=seed)
    enough = calibrated(trees, points, k, seed)

    def routed(batches):
        for batch in batches:
            points = _matrix(batch.column("vector"))
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), t), pa.int32()), pa.array(tree.route(points), pa.int32()), batch.column("id"), batch.column("vector")], ["tree", "leaf", "id", "vector"])

    def reached(batches):
        for batch in batches:
            points = _matrix(batch.column("vector"))
            sides = _sides(trees, points)
            at = [reach(trees, [s[i] for s in sides], enough) for i in range(len(points))]
            n = [len(x) for x in at]
            flat = np.array([y for x in at for y in x], np.int32).reshape(-1, 2)
            pick = pa.array(np.repeat(np.arange(len(points)), n))
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), batch.column("id").take(pick), batch.column("vector").take(pick)], ["tree", "leaf", "id", "vector"])

    cells = "tree int, leaf int, id long, vector array<float>"
    held = rows.select("id", "vector").mapInArrow(routed, cells)
    asked = queries.select("id", "vector").mapInArrow(reached, cells)

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = (_matrix(t.column("vector").chunk(0), np.float64) for t in (left, right))
        ids, asked_ids = (np.asarray(t.column("id")) for t in (left, right))
        out = []
        squares = (x**2).sum(axis=1)
        by_id = np.argsort(ids, kind="stable")  # rows of one id are one candidate, the nearest of them
        starts = np.flatnonzero(np.r_[True, ids[by_id][1:] != ids[by_id][:-1]])
        repeated = len(starts) < len(ids)
        for a in range(0, len(y), 256):
            q = y[a : a + 256]
            near = squares - 2 * (q @ x.T)
            near[asked_ids[a : a + 256, None] == ids[None, :]] = np.inf
            most = min(k + 8, len(x))
            pick = np.argpartition(near, most - 1, axis=1)[:, :most] if most < len(x) else np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
            for i in range(len(q)):
                # rows as near as the k-th, rounding apart, are all measured exactly
                slack = 1e-12 * (squares.max() + (q[i] ** 2).sum())
                if repeated:
                    nearest = np.minimum.reduceat(near[i, by_id], starts)
                    level = np.partition(nearest, min(k, len(nearest)) - 1)[min(k, len(nearest)) - 1]
                else:
                    level = np.partition(near[i, pick[i]], min(k, most) - 1)[min(k, most) - 1]
                c = pick[i] if not repeated and most == len(x) and level >= near[i, pick[i]].max() - slack else np.flatnonzero(near[i] <= level + slack)
                c = c[ids[c] != asked_ids[a + i]]
                score = np.sqrt(((x[c] - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((ids[c], score))
                if repeated:
                    order = order[np.sort(np.unique(ids[c][order], return_index=True)[1])]
                order = order[:k]
                out.append((np.full(len(order), asked_ids[a + i]), ids[c][order], score[order]))
        return pa.table({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("query_id", "vec_id", "score"))})

    def compared(held: DataFrame, asked: DataFrame) -> DataFrame:
        """The best k of each query: both sides of a leaf in blocks of bounded size, each block of rows against each of queries."""
        sizes = held.groupBy("tree", "leaf").agg(F.count("*").alias("n"))
        wanted = asked.groupBy("tree", "leaf").agg(F.count("*").alias("m"))
        sizes = cut(
            sizes.join(wanted, ["tree", "leaf"]).select(
                "tree", "leaf", F.ceil(F.col("n") / ROW_BLOCK).cast("int").alias("row_blocks"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("query_blocks")
            )
        )
        block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = held.join(sizes, ["tree", "leaf"]).withColumn("r", block("row_blocks", 1)).withColumn("q", every("query_blocks")).select("tree", "leaf", "r", "q", "id", "vector")
        asked = asked.join(sizes, ["tree", "leaf"]).withColumn("q", block("query_blocks", 2)).withColumn("r", every("row_blocks")).select("tree", "leaf", "r", "q", "id", "vector")
        pairs = held.groupBy("tree", "leaf", "r", "q").cogroup(asked.groupBy("tree", "leaf", "r", "q")).applyInArrow(ranked, kind)
        # a row found through several trees counts once
        best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = W.partitionBy("query_id").orderBy("score", "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = cut(compared(held, asked))
    # Where leaves hold many rows of few ids, too few may be found: such queries meet every leaf of one tree, and so every row.
    full = best.where(F.col("rank") == min(k, ids)).select(F.col("query_id").alias("id"))
    short = cut(queries.select("id", "vector").join(full, "id", "left_anti"))
    if not short.limit(1).count():
        return best
    again = short.withColumn("tree", F.lit(0)).withColumn("leaf", F.explode(F.sequence(F.lit(0), F.lit(len(trees[0].leaf_size) - 1)))).select("tree", "leaf", "id", "vector")
    return best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select(*best.columns).unionByName(compared(held.where("tree = 0"), again))


def neighbours(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest rows of each row of embeddings (vec_id, embedding) whose id `every` divides; odd rows as `search` says."""
    rows = embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, rows.where(F.col("id") % every == 0), k)
