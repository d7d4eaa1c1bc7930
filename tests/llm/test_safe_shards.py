"""Two vectors in range share a shard, so that sharding loses no link."""

import numpy as np

from tallywing.llm import graph_dedup


def pairs(rng, centre, spread, n, dim=64):
    """n unit vectors around centre, and for each a partner at a cosine of 0.981."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(centre + spread * rng.normal(size=(n, dim)))
    side = rng.normal(size=(n, dim))
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    return np.concatenate([x, 0.981 * x + np.sqrt(1 - 0.981**2) * side])


def found(spark, x):
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in graph_dedup.deduplicate(rows).collect()}
    y = x.astype(np.float32).astype(np.float64)
    norm = np.linalg.norm(y, axis=1)
    link = ((y @ y.T) / np.outer(norm, norm) >= 0.98) & ~np.eye(len(y), dtype=bool)
    return [got[i].n_links for i in range(len(y))], link.sum(axis=1).tolist()


def test_no_link_is_lost_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "SHARD_ROWS", 64)
    got, want = found(spark, pairs(np.random.default_rng(3), 0, 1, 400))
    assert sum(want) >= 700 and got == want


def test_no_link_is_lost_between_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "SHARD_ROWS", 64)
    used = []
    monkeypatch.setattr(graph_dedup, "_centres", lambda *a, real=graph_dedup._centres: used.append(real(*a)) or used[-1])
    rng = np.random.default_rng(4)
    got, want = found(spark, np.concatenate([pairs(rng, c, 0.6, 40) for c in 6 * rng.normal(size=(10, 64))]))
    assert used[0] and got == want


def test_pairs_in_range_share_a_centre():
    rng = np.random.default_rng(5)
    x = pairs(rng, 0, 1, 2000)
    at = graph_dedup.homes(x, x[rng.choice(4000, 256, replace=False)], 0.98)
    assert (at[:2000] & at[2000:]).any(axis=1).all() and at.mean() < 0.5
