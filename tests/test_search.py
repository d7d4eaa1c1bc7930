"""The search against a grid of the same size, and its trials in Spark jobs."""

import itertools
import math
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywing.operators import search
from tallywing.operators.search import Range, Trial


def surface(p):
    """One peak of height 0, off the grid, narrow by the logarithm of a."""
    return -((math.log10(p["a"]) + 2.37) ** 2) - 4 * (p["b"] - 0.317) ** 2 - 0.5 * (p["c"] - 7.1) ** 2


SPACE = {"a": Range(1e-4, 1e-1, True), "b": Range(0, 1), "c": Range(0.01, 10)}


def test_search_beats_a_grid_of_equal_size():
    axes = {"a": np.geomspace(1e-4, 1e-1, 4), "b": np.linspace(0, 1, 4), "c": np.linspace(0.01, 10, 4)}
    grid = max(surface(dict(zip(axes, p, strict=True))) for p in itertools.product(*axes.values()))  # 64 points
    found = [search.best(search.search(lambda ps: [surface(p) for p in ps], SPACE, 64, 20, seed)).value for seed in range(8)]
    assert np.median(found) > grid and np.mean([f > grid for f in found]) >= 0.75


def test_search_beats_random_points():
    later = [max(t.value for t in search.search(lambda ps: [surface(p) for p in ps], SPACE, 50, 20, s)) for s in range(12)]
    chance = [max(t.value for t in search.search(lambda ps: [surface(p) for p in ps], SPACE, 50, 50, s)) for s in range(12)]
    assert np.mean(later) > np.mean(chance)


def test_reruns_and_resumed_runs_agree():
    f = lambda ps: [surface(p) for p in ps]
    one, two = search.search(f, SPACE, 40, 10, 5), search.search(f, SPACE, 40, 10, 5)
    assert one == two and len(one) == 40 and search.search(f, SPACE, 40, 10, 5, done=one[:25]) == one
    assert one != search.search(f, SPACE, 40, 10, 6)
    assert all(SPACE[k].low <= v <= SPACE[k].high for t in one for k, v in t.point.items())


def test_failed_trials_count_as_the_worst():
    f = lambda ps: [None if p["b"] > 0.5 else float("nan") if p["b"] > 0.45 else surface(p) for p in ps]
    found = search.search(f, SPACE, 40, 10, 1)
    assert len(found) == 40 and search.best(found).point["b"] <= 0.45 and sum(t.value == -math.inf for t in found[20:]) < 15
    assert len(search.search(lambda ps: [None] * len(ps), SPACE, 12, 4)) == 12
    with pytest.raises(ValueError, match="values"):
        search.search(lambda ps: [1.0], SPACE, 10)
    with pytest.raises(ValueError, match="no range"):
        Range(0, 1, True)


def test_parzen_density_is_one_over_its_range():
    p = search._Parzen([0.1, 0.11, 3.9], (0.0, 4.0))
    x = np.linspace(0, 4, 40_001)
    assert abs(np.trapezoid(np.exp(p.log_density(x)), x) - 1) < 1e-3 and ((0 <= p.draw(np.random.default_rng(1), 500)) & (p.draw(np.random.default_rng(1), 500) <= 4)).all()


def test_trials_of_a_batch_run_side_by_side(spark):
    barrier = threading.Barrier(4, timeout=60)

    def one(p):
        barrier.wait()  # all four are under way at once
        return spark.range(100).select(F.sum(-F.pow(F.col("id") / 100 - F.lit(p["x"]), 2.0)).alias("s")).first()["s"]

    found = search.search(search.jobs(one, 4), {"x": Range(0, 1)}, 12, 8, together=4)
    assert len(found) == 12 and abs(search.best(found).point["x"] - 0.495) < 0.2


def test_hyperparameters_of_trained_models(spark):
    rng = np.random.default_rng(2)
    n = 240
    df = pd.DataFrame({"species": np.repeat(["x", "y"], n // 2), "a": rng.normal(size=n), "exposure": 1.0, "held": rng.random(n) < 0.3})
    df["count"] = rng.poisson(np.exp(0.5 + 0.8 * df.a)).astype(float)
    space = {"rate": Range(1e-4, 0.3, True), "power": Range(1.0, 2.0)}
    found = search.tuned(spark.createDataFrame(df), ["a"], space, epochs=6, trials=6, startup=3, together=3)
    assert len(found) == 6 and all(isinstance(t, Trial) and math.isfinite(t.value) for t in found)
    assert search.best(found).point["rate"] > min(t.point["rate"] for t in found)
