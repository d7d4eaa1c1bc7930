"""Models: Tweedie regression, a grid search over it, and penalised spline surfaces of hourly ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cache import shared_folder

FEATURES = ("sin_doy", "cos_doy", "sin_hour", "cos_hour")
DOY_SPLINES, HOUR_SPLINES = 4, 12
# Penalties on both axes, weakest first; the first under which the fit settles is taken.
PENALTIES = ((100, 10), (1000, 100), (10_000, 1_000), (100_000, 10_000))


def seasonal(df: DataFrame) -> DataFrame:
    turn = lambda c, n: F.lit(2 * np.pi) * F.col(c) / F.lit(float(n))
    return df.withColumns({"sin_doy": F.sin(turn("doy", 366)), "cos_doy": F.cos(turn("doy", 366)), "sin_hour": F.sin(turn("hour", 24)), "cos_hour": F.cos(turn("hour", 24))})


def _pipeline(power: float) -> tuple[Pipeline, GeneralizedLinearRegression]:
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol="rate", featuresCol="features", predictionCol="expected", regParam=1e-3, maxIter=50)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), glm]), glm


def fit_tweedie(df: DataFrame, power: float):
    """A log-linear Tweedie regression of rate on season and hour."""
    return _pipeline(power)[0].fit(seasonal(df))


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(seasonal(df)).drop("features", *FEATURES)


def fit_tweedie_each(df: DataFrame, power: float, by: str = "species", ridge: float = 1e-3, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """by, intercept and FEATURES: the coefficients of a log-linear Tweedie regression of each group of `by`.

    Reweighted least squares for all groups at once: a round sums each group's normal equations over
    the rows (combined before they are shuffled) and solves them beside each other; it takes no more
    passes for many groups than for one. A group of zeros alone has coefficients of null. Rows with a
    null take no part.
    """
    names = ["one", *FEATURES]
    rows = seasonal(df.select(by, F.col("rate").cast("double").alias("rate"), "doy", "hour").dropna()).withColumn("one", F.lit(1.0)).select(by, "rate", *names).persist()
    k, spark = len(names), df.sparkSession
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    schema = f"{by} {df.schema[by].dataType.simpleString()}, beta array<double>, settled boolean"

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = np.diag([0.0] + [ridge] * (k - 1))
        for batch in batches:
            sums, old = np.array(batch.column("sums").to_pylist(), float).reshape(batch.num_rows, -1), np.array(batch.column("beta").to_pylist(), float).reshape(batch.num_rows, -1)
            betas, ends = [], []
            for s, b in zip(sums, old, strict=True):
                a, c = np.zeros((k, k)), s[len(pairs) : -1]
                for (i, j), v in zip(pairs, s, strict=False):
                    a[i, j] = a[j, i] = v
                try:
                    new = np.linalg.solve(a / s[-1] + shrink, c / s[-1])
                except np.linalg.LinAlgError:
                    new = np.full(k, np.nan)
                fine = np.isfinite(new).all()
                betas.append(new.tolist() if fine else None)
                ends.append(not fine or bool(np.abs(new - b).max() <= tolerance * max(1.0, np.abs(new).max())))
            yield pa.record_batch([batch.column(by), pa.array(betas, pa.list_(pa.float64())), pa.array(ends)], names=[by, "beta", "settled"])

    try:
        mean = rows.groupBy(by).agg(F.avg("rate").alias("mean"))
        start = F.when(F.col("mean") > 0, F.concat(F.array(F.log("mean")), F.array_repeat(F.lit(0.0), k - 1)))
        folder = shared_folder(spark, "regressions")
        mean.select(by, start.alias("beta"), start.isNull().alias("settled")).write.parquet(f"{folder}/0")
        state, n = spark.read.parquet(f"{folder}/0"), 0
        while n < rounds and state.where("NOT settled").limit(1).count():
            n += 1
            met = rows.join(state.where("NOT settled").select(by, "beta"), by)
            eta = sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(names)), F.lit(0.0))
            mu = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("eta"))))
            met = met.withColumn("eta", eta).withColumn("mu", mu).withColumn("w", F.pow("mu", 2 - power)).withColumn("z", F.col("eta") + F.col("rate") / F.col("mu") - 1)
            sums = [F.sum(F.col("w") * F.col(names[i]) * F.col(names[j])) for i, j in pairs] + [F.sum(F.col("w") * F.col(c) * F.col("z")) for c in names] + [F.sum("w")]
            moved = met.groupBy(by).agg(F.array(*sums).alias("sums"), F.first("beta").alias("beta")).mapInArrow(solved, schema)
            state.where("settled").unionByName(moved).write.parquet(f"{folder}/{n}")
            state = spark.read.parquet(f"{folder}/{n}")
    finally:
        rows.unpersist()
    return state.select(by, *[F.col("beta")[i].alias(name) for i, name in enumerate(["intercept", *FEATURES])])


def predict_each(models: DataFrame, df: DataFrame, by: str = "species") -> DataFrame:
    """df with expected, by the regression of each row's group; models as of fit_tweedie_each."""
    models = models.select(by, F.col("intercept").alias("sum_"), *[F.col(f).alias(f"{f}_") for f in FEATURES])
    out = seasonal(df).join(models, by)
    return out.withColumn("expected", F.exp(sum((F.col(f) * F.col(f"{f}_") for f in FEATURES), F.col("sum_")))).select(*df.columns, "expected")


def tweedie_coefficients(df: DataFrame, power: float, by: str = "species") -> DataFrame:
    """by, term and coefficient of the regression of each group of `by`."""
    return fit_tweedie_each(df, power, by).unpivot(by, ["intercept", *FEATURES], "term", "coefficient")


def search_tweedie(df: DataFrame, powers: tuple[float, ...], penalties: tuple[float, ...], seed: int = 0):
    """The best of a grid of powers and penalties on a held-out part."""
    pipeline, glm = _pipeline(powers[0])
    grid = ParamGridBuilder().addGrid(glm.variancePower, list(powers)).addGrid(glm.regParam, list(penalties)).build()
    judge = RegressionEvaluator(labelCol="rate", predictionCol="expected", metricName="r2")
    return TrainValidationSplit(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, trainRatio=0.8, seed=seed).fit(seasonal(df)).bestModel


def spline_basis(x: np.ndarray, low: float, high: float, n: int, degree: int = 3) -> np.ndarray:
    """n B-splines over evenly spaced knots."""
    inner = n - degree
    knots = low + (high - low) / inner * np.arange(-degree, n + 1)
    x = np.clip(x, low, np.nextafter(high, low))[:, None]
    out = ((x >= knots[:-1]) & (x < knots[1:])).astype(float)
    for d in range(1, degree + 1):
        left = (x - knots[: -d - 1]) / (knots[d:-1] - knots[: -d - 1])
        right = (knots[d + 1 :] - x) / (knots[d + 1 :] - knots[1:-d])
        out = left * out[:, :-1] + right * out[:, 1:]
    return out


def _design(doy: np.ndarray, hour: np.ndarray, interaction: bool = True) -> np.ndarray:
    """Products of the splines of both axes, or with interaction=False their splines side by side."""
    a, b = spline_basis(doy, 1, 366, DOY_SPLINES), spline_basis(hour, 0, 23, HOUR_SPLINES)
    return (a[:, :, None] * b[:, None, :]).reshape(len(doy), -1) if interaction else np.hstack([a, b])


def _penalty(weights: tuple[float, float], interaction: bool = True) -> np.ndarray:
    second = lambda n: np.diff(np.eye(n), 2, axis=0).T @ np.diff(np.eye(n), 2, axis=0)
    if interaction:
        return weights[0] * np.kron(second(DOY_SPLINES), np.eye(HOUR_SPLINES)) + weights[1] * np.kron(np.eye(DOY_SPLINES), second(HOUR_SPLINES)) + 1e-6 * np.eye(DOY_SPLINES * HOUR_SPLINES)
    out = 1e-6 * np.eye(DOY_SPLINES + HOUR_SPLINES)  # also settles the constant that both axes share
    out[:DOY_SPLINES, :DOY_SPLINES] += weights[0] * second(DOY_SPLINES)
    out[DOY_SPLINES:, DOY_SPLINES:] += weights[1] * second(HOUR_SPLINES)
    return out


def fit_surface(doy: np.ndarray, hour: np.ndarray, ratio: np.ndarray, weight: np.ndarray, interaction: bool = True) -> np.ndarray:
    """A Poisson surface (366, 24) by penalised iteratively reweighted least squares on grouped samples.

    Without interaction it is a factor a day times one hourly shape, the same on all days.
    """
    x = _design(doy, hour, interaction)
    grid = _design(np.repeat(np.arange(1, 367), 24).astype(float), np.tile(np.arange(24), 366).astype(float), interaction)
    for penalties in PENALTIES:
        s, beta = _penalty(penalties, interaction), np.full(x.shape[1], np.log(max(np.average(ratio, weights=weight), 1e-3)) / (1 if interaction else 2))
        for _ in range(100):
            mu = np.exp(np.clip(x @ beta, -20, 20))
            w = weight * mu
            z = x @ beta + (ratio - mu) / mu
            new = np.linalg.solve(x.T @ (w[:, None] * x) + s, x.T @ (w * z))
            moved = np.abs(new - beta).max()
            beta = new
            if not np.isfinite(moved) or moved < 1e-6:
                break
        if np.isfinite(beta).all() and moved < 1e-6:
            return np.exp(np.clip(grid @ beta, -20, 20)).reshape(366, 24)
    raise ArithmeticError("no penalty lets the surface settle")


def ratio_surfaces(samples: DataFrame, interaction: bool = True) -> DataFrame:
    """species, doy, hour and ratio of the surface with or without interaction; samples (species, doy, hour, ratio) are first averaged by species, day and hour, 8 784 cells at most."""
    cells = samples.groupBy("species", "doy", "hour").agg(F.avg("ratio").alias("ratio"), F.count("*").cast("double").alias("weight"))

    def fitted(table: pa.Table) -> pa.Table:
        doy, hour, ratio, weight = (np.asarray(table.column(c), float) for c in ("doy", "hour", "ratio", "weight"))
        surface = fit_surface(doy, hour, ratio, weight, interaction)
        return pa.table({
            "species": pa.array([table.column("species")[0].as_py()] * surface.size, table.schema.field("species").type), "doy": pa.array(np.repeat(np.arange(1, 367), 24).astype(np.int32)),
            "hour": pa.array(np.tile(np.arange(24), 366).astype(np.int32)), "ratio": pa.array(surface.ravel()),
        })

    return cells.groupBy("species").applyInArrow(fitted, f"species {samples.schema['species'].dataType.simpleString()}, doy int, hour int, ratio double")


def poisson_deviance(samples: DataFrame, fitted: DataFrame, by: tuple[str, ...], on: tuple[str, ...], name: str = "deviance") -> DataFrame:
    """by, n and the Poisson deviance of samples (ratio) from what is fitted (expected) at the same `on`; samples without a fit don't count."""
    y, mu = F.col("ratio"), F.col("expected")
    loss = 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(F.lit(0.0)) - (y - mu))
    return samples.join(fitted.where("expected > 0"), list(on)).groupBy(*by).agg(F.count("*").alias("n"), F.sum(loss).alias(name))


def surface_deviances(samples: DataFrame) -> DataFrame:
    """species, n, and the deviances of the samples from the surface with interaction, the one without, and the mean ratio of each hour."""
    on = ("species", "doy", "hour")
    samples = samples.where(F.col("ratio").isNotNull()).select(*on, "ratio")
    expected = lambda df: df.withColumnRenamed("ratio", "expected")
    found = poisson_deviance(samples, expected(ratio_surfaces(samples)), ("species",), on, "interaction")
    for name, fitted, keys in (("additive", ratio_surfaces(samples, False), on), ("hourly", samples.groupBy("species", "hour").agg(F.avg("ratio").alias("ratio")), ("species", "hour"))):
        found = found.join(poisson_deviance(samples, expected(fitted), ("species",), keys, name).drop("n"), "species")
    return found
