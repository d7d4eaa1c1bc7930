"""Whitening of embeddings by a QR factorisation of all centred rows, without their covariance.

Entries are first put on a grid of whole numbers, so that counts, sums and deviations are exact.
Each partition reduces its centred rows to a triangular factor, factors are stacked and reduced
again in a tree, and the right singular vectors of the last one are the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Factors that one task of the tree stacks, rows that are stacked onto a factor at once, bytes of work arrays.
FAN, BLOCK_BYTES = 16, 8 << 20
_SAFE = 1 << 62


@dataclass
class Whitening:
    """n fitted vectors, their sums by dimension, unit components (columns), eigenvalues, trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def directions(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def on_grid(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Its vec_id and x, the entries as whole numbers (held within 62 bits); rows that take part only."""
    v = F.col(vector).cast("array<double>")
    inf = F.lit(float("inf"))
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == inf))
    most = F.lit(_SAFE)
    return embeddings.where(F.col(vector).isNotNull() & ~odd).select("vec_id", F.transform(v, lambda c: F.least(most, F.greatest(-most, F.floor(c * GRID))) + OFFSET).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x")).flatten()
    return x.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    step = max(x.shape[1], BLOCK_BYTES // (8 * max(1, x.shape[1])))
    for at in range(0, len(x), step):
        yield x[at : at + step]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where nothing can overflow, else as Python's whole numbers."""
    most = max(int(abs(x).max(initial=0)) * n, *(abs(s) for s in sums))
    if most < _SAFE // 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(np.float64)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch, d)
            high, low = x >> 32, x & 0xFFFFFFFF  # halves whose sums over a batch fit in 64 bits
            n, total = n + len(x), total + high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
        if n:
            yield pa.record_batch({"place": pa.array([*range(d), d], pa.int32()), "part": pa.array([*map(str, total), str(n)])})

    whole = fit.mapInArrow(partial, "place int, part string").groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found = {r.place: int(r.total) for r in whole.collect()}
    return found.pop(d, 0), [found.get(i, 0) for i in range(d)]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The d x d triangular factor of rows, filled up with rows of zeros."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def _factor(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangular factor of all centred rows: one for each partition, merged FAN by FAN."""
    d, schema = len(sums), "node long, r array<double>"

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for batch in batches:
            for block in _blocks(_matrix(batch, d)):
                rows = _centred(block, n, sums)
                r = _triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.record_batch({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def merge(table: pa.Table) -> pa.Table:
        r = None
        for row in sorted(table.to_pylist(), key=lambda row: row["node"]):  # the same order in every run
            new = np.array(row["r"]).reshape(d, d)
            r = new if r is None else _triangle(np.vstack([r, new]))
        return pa.table({"node": pa.array([table["node"][0].as_py() // FAN], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    spark = fit.sparkSession
    to = new_path(spark, "whitening-factors")
    fit.mapInArrow(leaf, schema).write.parquet(to)
    factors = spark.read.parquet(to)
    most = factors.agg(F.max("node")).first()[0]
    while most:
        factors, most = factors.groupBy(F.expr(f"node div {FAN}")).applyInArrow(merge, schema), most // FAN
    return np.array(factors.first().r).reshape(d, d)


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of distinct vectors x of d dimensions.

    Components without any variance (to double precision) don't count; there may be none.
    """
    n, sums = _sums(vectors, d)
    if not n:
        return Whitening(0, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    _, s, right = np.linalg.svd(_factor(vectors, n, sums))
    e = s * s / n
    used = min(components, int((s > s.max(initial=0) * d * np.finfo(float).eps).sum()))
    return Whitening(n, sums, right[:used].T.copy(), e[:used].copy(), float(e.sum()))


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    k, d = len(w.eigenvalues), len(w.sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pairs, directions = np.zeros(k), np.zeros((k, k)), w.directions
        for batch in batches:
            for block in _blocks(_matrix(batch, d)):
                z = _centred(block, w.n, w.sums) @ directions
                total, pairs = total + z.sum(0), pairs + z.T @ z
        yield pa.record_batch({"place": pa.array(range(k + k * k), pa.int32()), "part": pa.array(np.r_[total, pairs.ravel()])})

    rows = vectors.mapInArrow(partial, "place int, part double").groupBy("place").agg(F.sum("part").alias("total")).orderBy("place").collect()
    found = np.array([r.total for r in rows]) / w.n
    mean, pairs = found[:k], found[k:].reshape(k, k)
    return float(abs(pairs - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def _whitened(rows: DataFrame, w: Whitening, error: float) -> DataFrame:
    k, d = len(w.eigenvalues), len(w.sums)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions, explained = w.directions, w.eigenvalues / (w.trace or 1.0)
        for batch in batches:
            at = 0
            for block in _blocks(_matrix(batch, d)):
                m, scaled = len(block), _scaled(block, w.n, w.sums)
                if scaled.dtype != object and d * int(abs(scaled).max()) ** 2 >= _SAFE:
                    squares = (scaled.astype(object) ** 2).sum(1)
                else:
                    squares = (scaled * scaled).sum(1)
                exact = [int(v) for v in squares]
                z = (scaled / w.n).astype(np.float64) @ directions
                ids = batch.column(batch.schema.get_field_index("vec_id")).slice(at, m)
                at += m
                yield pa.record_batch([
                    ids.take(pa.array(np.repeat(np.arange(m), k))).cast(pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    pa.array([v if v < 1 << 63 else None for v in exact for _ in range(k)], pa.int64()), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    pa.array([str(v) for v in exact for _ in range(k)]),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text"])

    return rows.mapInArrow(each, schema)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each vector on the leading whitened components: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors and those with null or non-finite entries go; zero vectors stay. Vectors of another
    length than the commonest one (the longest of these) have no place in the same space and go too,
    as do empty ones. A component without variance can't be whitened: there are as many components
    as the vectors have dimensions that vary, and no rows if there are none, as for one vector or an
    empty table. Copies of a vector count once in the fit and have a row each; a null or repeated
    vec_id is a row like any other. `deviation` is null where it takes more than 63 bits;
    `deviation_text` has it in full. Other columns are not read.
    """
    spark, rows = embeddings.sparkSession, on_grid(embeddings)
    length = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = length.d if length else 0
    rows = rows.where(F.size("x") == d)
    to = new_path(spark, "whitening-vectors")
    rows.select("x").distinct().write.parquet(to)
    vectors = spark.read.parquet(to)
    w = fit(vectors, d, components)
    return _whitened(rows, w, identity_error(vectors, w) if len(w.eigenvalues) else 0.0)
