"""The hourly surface with and without interaction, and what each leaves unexplained."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing import registered
from tallywing.operators import fitting


def samples(drift):
    """Ratios whose peak hour moves by `drift` hours over the season."""
    rng = np.random.default_rng(8)
    doy, hour = np.meshgrid(np.arange(196, 336), np.arange(6, 18), indexing="ij")
    peak = 10 + drift * (doy - 196) / 140
    mean = np.exp(-(((hour - peak) / 2.5) ** 2)) * (1 + 0.5 * np.sin(doy / 30)) + 0.05
    return doy.ravel().astype(float), hour.ravel().astype(float), rng.gamma(20, mean.ravel() / 20)


def test_additive_shapes_are_equal_by_day():
    surface = fitting.fit_surface(*samples(4), np.ones(140 * 12), interaction=False)
    shapes = surface[:, 6:18] / surface[:, 6:18].sum(1, keepdims=True)
    assert np.abs(shapes - shapes[0]).max() < 1e-9 and surface[:, 10].std() > 0.01  # the factor of the day differs
    both = fitting.fit_surface(*samples(4), np.ones(140 * 12))
    shapes = both[196:336, 6:18] / both[196:336, 6:18].sum(1, keepdims=True)
    assert shapes[-1].argmax() - shapes[0].argmax() >= 2


def test_interaction_explains_a_moving_peak(spark):
    rows = [("moves", *map(float, r)) for r in zip(*samples(5), strict=True)] + [("stays", *map(float, r)) for r in zip(*samples(0), strict=True)]
    df = spark.createDataFrame(rows, "species string, doy double, hour double, ratio double").withColumns({"doy": F.col("doy").cast("int"), "hour": F.col("hour").cast("int")})
    got = {r.species: r for r in fitting.surface_deviances(df).collect()}
    assert got["moves"].interaction < 0.7 * got["moves"].additive and got["stays"].interaction > 0.9 * got["stays"].additive
    assert got["moves"].additive < got["moves"].hourly and got["moves"].n == 140 * 12


def test_deviance_of_a_perfect_and_a_missing_fit(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0), ("b", 1, 3.0)], "species string, doy int, ratio double")
    fit = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.5), ("b", 1, 0.0)], "species string, doy int, expected double")
    got = fitting.poisson_deviance(df, fit, ("species",), ("species", "doy")).collect()
    assert [(r.species, r.n, r.deviance) for r in got] == [("a", 2, pytest.approx(1.0))]


def test_queries_cover_every_species(spark, small):
    queries = registered.queries()
    deviances, models = queries["ratio_surface_deviances"](spark, small).collect(), queries["trained_models"](spark, small).collect()
    every = {r.species for r in queries["ratio_deviance"](spark, small).collect()}
    assert {r.species for r in deviances} == every == {r.species for r in models} and len(every) > 3
    assert all(r.interaction <= r.hourly * 1.5 and r.n > 0 for r in deviances) and all(0 < r.epochs <= 12 and r.loss < float("inf") for r in models)
