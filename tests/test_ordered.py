"""Ranks, quantiles, next known keys and overlaps against plain ones, with groups that no task sees whole."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.operators import intervals, ordered, scoring

T = datetime.datetime


@pytest.fixture(scope="module")
def values(spark):
    """A hot group with a hot value, a small one, a group of one, a null group, nulls and ties."""
    rng = np.random.default_rng(1)
    rows = [("hot", 0.0 if rng.random() < 0.4 else round(float(rng.gamma(2, 5)), 2), float(rng.normal())) for _ in range(6000)]
    rows += [("few", float(i % 3), float(i)) for i in range(7)] + [("one", 5.0, 1.0), (None, 1.0, 2.0), (None, 2.0, 1.0), ("hot", None, 1.0), ("few", 2.0, None), ("nothing", None, None)]
    return spark.createDataFrame(rows, "g string, x double, y double").repartition(5).cache()


def test_ranks_equal_plain_ones(values):
    got = ordered.with_rank(values, ["g"], "x", "r").toPandas()
    want = got.groupby("g", dropna=False)["x"].rank()
    assert len(got) == values.count() and ((got.r == want) | (got.r.isna() & want.isna())).all() and list(got.columns) == ["g", "x", "y", "r"]


def test_cumulative_counts(values):
    got = ordered.cumulative(values, ["g"], "x").toPandas()
    plain = values.toPandas().dropna(subset=["x"])
    for r in got.itertuples():
        same = plain[plain.g.isna()] if r.g is None or r.g != r.g else plain[plain.g == r.g]
        if r.x in (0.0, 1.0, 2.0, 5.0):
            assert (r.n, r.below, r.total) == ((same.x == r.x).sum(), (same.x < r.x).sum(), len(same))
    assert got[got.g == "hot"].n.sum() == 6000


def test_spearman_of_a_hot_group_over_many_tasks(spark, values):
    got = {r.g: r.spearman for r in scoring.spearman(values, "x", "y", ("g",)).collect()}
    df = values.toPandas().dropna(subset=["x", "y"])
    for g in ("hot", "few"):
        some = df[df.g == g]
        assert abs(got[g] - some.x.rank().corr(some.y.rank())) < 1e-9
    assert abs(got[None] + 1) < 1e-12 and got["one"] is None and "nothing" not in got
    placed = ordered._placed(values.where("g = 'hot'").groupBy("g", "y").count(), ["g"], ["y"])
    sizes = [r["n"] for r in placed.groupBy("part_").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 0.6 * sum(sizes)


def test_quantiles_equal_plain_ones(values):
    levels = (0, 1, 10, 50, 90, 99, 100)
    got = {(r.g, r.level): r.quantile for r in ordered.quantiles(values.unionByName(values.limit(1).withColumns({"g": F.lit("few"), "x": F.lit(float("nan"))})), ["g"], "x", levels).collect()}
    df = values.toPandas().dropna(subset=["x"])
    for g in ("hot", "few", "one"):
        for x in levels:
            assert abs(got[g, x] - np.percentile(df[df.g == g].x, x)) < 1e-9
    assert got[None, 50] == 1.5 and len(got) == 4 * len(levels)


def test_next_known_key_on_a_grid_with_holes(spark):
    rng = np.random.default_rng(2)
    grid = {g: sorted(rng.choice(5000, 40 if g else 1500, replace=False).tolist()) for g in (0, 1)}
    asked = [(int(g), int(a)) for g, a in zip(rng.integers(0, 3, 4000), rng.integers(-50, 5100, 4000), strict=True)] + [(0, None), (None, 3)] + [(1, 77)] * 3000
    rows = spark.createDataFrame([(g, k) for g, ks in grid.items() for k in [*ks, ks[0]]] + [(0, None)], "g int, at int")
    got = ordered.with_next(spark.createDataFrame(asked, "g int, at int").withColumn("id", F.monotonically_increasing_id()), rows, ["g"], "at").collect()
    assert len(got) == len(asked)
    for r in got:
        ks = grid.get(r.g)
        want = None if ks is None or r["at"] is None else ks[min(int(np.searchsorted(ks, r["at"])), len(ks) - 1)]
        assert r.known == want


def test_long_intervals_make_few_rows(spark):
    rows = [(1, T(2010, 1, 1), T(2020, 1, 1)), (2, T(2015, 3, 1, 5), T(2015, 3, 1, 6)), (3, T(1900, 1, 1), T(2300, 1, 1)), (4, T(2020, 1, 1), T(2020, 1, 1))]
    df = spark.createDataFrame(rows, "id long, start timestamp, end timestamp")
    placed = intervals._placed(df)
    every = F.array(*[F.lit(n) for n in range(intervals.LEVELS)])
    blocks = intervals._blocks(placed, F.filter(every, lambda n: n >= F.col("level_"))).groupBy("id").count().collect()
    assert {r["id"] for r in blocks} == {1, 2, 3, 4} and max(r["count"] for r in blocks) < 50
    assert [r.id for r in intervals.overlapping(df, df, "id", unlike_itself=True).orderBy("id").collect()] == [1, 2, 3, 4]


def test_overlaps_of_all_lengths_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    base = T(2019, 12, 31, 23)

    def some(n, first):
        return [(first + i, int(rng.integers(0, 2)), base + datetime.timedelta(minutes=int(s)), base + datetime.timedelta(minutes=int(s) + int(m))) for i, (s, m) in enumerate(zip(rng.integers(0, 500_000, n), rng.choice([-30, 0, 15, 60, 600, 20_000, 250_000], n, p=[0.1, 0.1, 0.3, 0.2, 0.2, 0.09, 0.01]), strict=True))]

    left, right = some(300, 0) + [(998, 0, None, base), (999, 0, base, None)], some(60, 1000)
    schema = "id long, g int, start timestamp, end timestamp"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    known = [r for r in left if r[2] and r[3]]
    want = {x[0] for x in known for y in right if x[1] == y[1] and x[2] < y[3] and x[3] > y[2]}
    assert {r.id for r in intervals.overlapping(a, b, "id", ("g",)).collect()} == want and 30 < len(want) < 300
    assert {r.id for r in intervals.apart(a, b, "id", ("g",)).collect()} == {r[0] for r in left} - want
    own = {x[0] for x in known for y in known if x[0] != y[0] and x[2] < y[3] and x[3] > y[2]}
    assert {r.id for r in intervals.overlapping(a, a, "id", unlike_itself=True).collect()} == own
    assert not intervals.overlapping(a, b.where("false"), "id").count() and intervals.apart(a, b.where("false"), "id").count() == len(left)


def test_plain_helpers_agree_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, x double, y double")
    assert not ordered.with_rank(empty, ["g"], "x", "r").count() and not ordered.quantiles(empty, ["g"], "x", (50,)).count() and not scoring.spearman(empty, "x", "y", ("g",)).count()
    assert not ordered.with_next(empty.select("g", "x"), empty.select("g", "x"), ["g"], "x").count()
