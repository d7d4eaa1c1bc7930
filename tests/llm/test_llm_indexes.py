"""The indexes above their sample bounds, and vectors with odd ids and labels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallywing.llm import ann, graph_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, label=None):
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32())), "label": label if label is not None else np.zeros(len(x), np.int32)})
    return spark.createDataFrame(table)


def recall(got, x, every):
    asked = np.arange(0, len(x), every)
    y = x.astype(np.float32).astype(np.float64)
    near = (y**2).sum(axis=1) - 2 * y[asked] @ y.T
    near[np.arange(len(asked)), asked] = np.inf
    true = np.argpartition(near, 9, axis=1)[:, :10]
    own = got.groupby("query_id").vec_id.agg(set)
    return np.mean([len(own[q] & set(t.tolist())) / 10 for q, t in zip(asked.tolist(), true, strict=True)])


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_forest_recall_above_the_sample(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30_000, 32))
    if kind == "clusters":
        x = x * 0.25 + rng.normal(size=(300, 32))[rng.integers(0, 300, len(x))]
    assert len(x) > ann.SAMPLE_ROWS
    got = ann.neighbours(frame(spark, unit(x))).toPandas()
    assert recall(got, unit(x), 100) >= 0.9
    if kind == "clusters":  # the queue stops early where the data let it
        points = unit(x)[: ann.SAMPLE_ROWS].astype(np.float32)
        assert ann.calibrated(ann.forest(points, len(x)), points, 10) < 0.3 * len(points)


def test_far_vectors_keep_their_ties(spark):
    x = np.full((40, 4), 1e5)
    x[:, 0] += np.arange(40) % 4
    got = ann.neighbours(frame(spark, x), 5, 10).toPandas()
    y = x.astype(np.float32).astype(np.float64)
    for q in range(0, 40, 10):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(40), d))[:5].tolist()


def test_graph_links_above_the_sample(spark):
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(24_000, 32)))
    copies = rng.integers(0, 3000, 6000)
    x = np.concatenate([x, unit(x[copies] + 0.02 * rng.normal(size=(6000, 32)))])
    label = rng.integers(0, 8, len(x)).astype(np.int32)
    assert len(x) > graph_dedup.SAMPLE_ROWS
    got = graph_dedup.deduplicate(frame(spark, x, label)).toPandas().set_index("vec_id").n_links
    y, want = unit(x.astype(np.float32).astype(np.float64)), np.zeros(len(x), int)
    for v in range(8):
        own = np.flatnonzero(label == v)
        want[own] = ((y[own] @ y[own].T) >= 0.98).sum(axis=1) - 1
    assert (got.loc[np.arange(len(x))].to_numpy() <= want).all() and got.sum() >= 0.99 * want.sum() > 500


def test_ids_may_repeat_and_labels_have_any_type(spark):
    rows = [(5, [1.0, 0.0], "x"), (5, [0.0, 1.0], "x"), (6, [1.0, 0.01], "x"), (7, [0.01, 1.0], "x"), (8, [1.0, 0.0], "y"), (None, [1.0, 0.0], "x"), (9, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumns({"p": F.lit(1), "copies": F.lit(2)})
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id) for r in graph_dedup.deduplicate(df).collect()), key=str)
    assert got == sorted([(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (8, 0, 8), (0, 0, None), (9, 0, 9)], key=str)
    apart = graph_dedup.deduplicate(spark.createDataFrame([(6, [1.0, 0.01], 1.2), (5, [1.0, 0.0], 1.2), (3, [1.0, 0.0], 1.7), (5, [0.0, 1.0], 1.2), (7, [0.01, 1.0], 1.2), (4, [0.0, 1.0], 1.2)], "vec_id long, embedding array<float>, label double"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in apart.collect()) == [(3, 0, 3), (4, 2, 4), (5, 1, 5), (5, 2, 4), (6, 1, 5), (7, 2, 4)]


def test_repeated_ids_never_crowd_others_out(spark):
    """Nineteen rows of one id are nearest; a thousand rows of another fill the leaves: ten ids are found all the same."""
    rng = np.random.default_rng(3)
    near, far = rng.normal(size=(19, 8)) * 0.001 + 1, rng.normal(size=(12, 8)) + 3
    crowd = rng.normal(size=(3000, 8)) * 0.01 + 1
    x = np.concatenate([np.ones((1, 8)), near, crowd, far])
    ids = np.r_[100, np.full(19, 1), np.full(3000, 2), np.arange(3, 15)]
    df = frame(spark, x).withColumn("place", F.col("vec_id"))
    names = spark.createDataFrame(pa.table({"place": np.arange(len(x)), "own": ids}))
    df = df.join(names, "place").select(F.col("own").alias("vec_id"), "embedding")
    got = ann.neighbours(df).orderBy("rank").collect()
    y = x.astype(np.float32).astype(np.float64)
    d = np.sqrt(((y - y[0]) ** 2).sum(1))
    best = sorted((d[ids == i].min(), i) for i in set(ids.tolist()) - {100})[:10]
    assert [(r.query_id, r.vec_id) for r in got] == [(100, i) for _, i in best] and np.allclose([r.score for r in got], [b[0] for b in best], rtol=0, atol=1e-12)
