"""Log-linear models trained by gradients of a weighted sum of losses, all groups in the same jobs.

An epoch is one pass over the rows: each meets its group's weights, and what comes back is a sum of
gradients and losses a group, combined before it is shuffled. Weights, moments and counters are a
table of a row a group, which the next epoch reads from the shared folder; so a run that was
stopped goes on from its last epoch, and no number of groups passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import poisson_nll, squared_error, squared_log_error, tweedie
from ..registry import HYPERPARAMETERS
from ..sources.cache import kept, shared_folder

# Adam's decay rates and filler; the rate falls tenfold after so many epochs without a relative gain.
BETAS, EPSILON = (0.9, 0.999), 1e-8
PLATEAU_FACTOR, PLATEAU_PATIENCE, PLATEAU_GAIN = 0.1, 2, 1e-4
PATIENCE = 10
#: Learning rate, weight decay, loss weight and Tweedie power where the table of species has none.
DEFAULTS = (0.01, 0.0, 1.0, 1.5)
#: The loss has no value at 1 and 2.
POWERS = (1.001, 1.999)
HYPER = ("rate", "decay", "weight", "power")
MOST_LOG = 20.0


@dataclass(frozen=True)
class Term:
    """A loss of observed and expected counts with its slope by the logarithm of what is expected; power is the group's Tweedie power."""

    loss: object
    slope: object


TERMS = {
    "tweedie": Term(lambda y, mu, power: tweedie(y, mu, power), lambda y, mu, power: F.pow(mu, 2 - power) - y * F.pow(mu, 1 - power)),
    "poisson": Term(lambda y, mu, power: poisson_nll(y, mu), lambda y, mu, power: mu - y),
    "squared_log": Term(lambda y, mu, power: squared_log_error(y, mu), lambda y, mu, power: 2 * (F.log1p(mu) - F.log1p(y)) * mu / (1 + mu)),
    "squared": Term(lambda y, mu, power: squared_error(y, mu), lambda y, mu, power: 2 * (mu - y) * mu),
}


def hyperparameters(spark: SparkSession) -> DataFrame:
    """species, rate, decay, weight and power of the species that have values of their own."""
    return spark.createDataFrame([(s, *map(float, v)) for s, v in HYPERPARAMETERS.items()], "species string, " + ", ".join(f"{h} double" for h in HYPER))


def _share(name: str, terms: Mapping[str, float], weight: Column) -> Column:
    return weight * F.lit(float(terms[name])) if name == "tweedie" else F.lit(float(terms[name]))


def summed_loss(observed: Column, expected: Column, weight: Column, power: Column, terms: Mapping[str, float]) -> Column:
    """The weighted sum of the loss terms of a row; weight goes to the Tweedie term, power is its power."""
    return sum((_share(n, terms, weight) * TERMS[n].loss(observed, expected, power) for n in terms), F.lit(0.0))


def summed_slope(observed: Column, expected: Column, weight: Column, power: Column, terms: Mapping[str, float]) -> Column:
    """Its slope by the logarithm of what is expected."""
    return sum((_share(n, terms, weight) * TERMS[n].slope(observed, expected, power) for n in terms), F.lit(0.0))


def _log_rate(features: Sequence[str]) -> Column:
    total = F.element_at("w", 1) + sum((F.col(f) * F.element_at("w", i) for i, f in enumerate(features, 2)), F.lit(0.0))
    return F.greatest(F.lit(-MOST_LOG), F.least(F.lit(MOST_LOG), total))


def _sums(rows: DataFrame, state: DataFrame, by: str, features: Sequence[str], terms: Mapping[str, float]) -> DataFrame:
    """by, gradient (a mean over the rows to learn from), train and held (mean losses there and on the held rows)."""
    met = rows.join(state.where(~F.col("done")).select(by, "w", "weight", "power"), by)
    met = met.withColumn("mu", F.col("exposure") * F.exp(_log_rate(features)))
    row = F.col("count"), F.col("mu"), F.col("weight"), F.col("power"), terms
    met = met.withColumns({"loss": summed_loss(*row), "slope": summed_slope(*row)})
    learn = ~F.col("held")
    mean = lambda c: F.coalesce(F.avg(F.when(learn, c)), F.lit(0.0))
    slopes = F.array(mean(F.col("slope")), *[mean(F.col("slope") * F.col(f)) for f in features])
    return met.groupBy(by).agg(slopes.alias("gradient"), F.avg(F.when(learn, F.col("loss"))).alias("train"), F.avg(F.when(F.col("held"), F.col("loss"))).alias("held_loss"))


def _stepped(state: DataFrame, sums: DataFrame, by: str) -> DataFrame:
    """The state after an epoch; groups that are done keep theirs."""
    s = state.join(sums, by, "left")
    # Without held rows the rows to learn from are judged.
    judged = F.coalesce("held_loss", "train")
    failed = judged.isNull() | F.isnan(judged) | (F.abs(judged) == F.lit(float("inf")))
    # Before the first gain plateau_best is infinite and the bound NaN, which Spark takes for larger than any number.
    better, gained = ~failed & (judged < F.col("best")), ~failed & (judged < F.col("plateau_best") - F.abs("plateau_best") * PLATEAU_GAIN)
    s = s.withColumn("judged", judged).withColumns({
        "best_w": F.when(better, F.col("w")).otherwise(F.col("best_w")), "best": F.when(better, judged).otherwise(F.col("best")), "bad": F.when(better, 0).otherwise(F.col("bad") + 1),
        "plateau_best": F.when(gained, judged).otherwise(F.col("plateau_best")), "flat": F.when(gained, 0).otherwise(F.col("flat") + 1), "failed": failed,
    })
    s = s.withColumn("falls", F.col("flat") > PLATEAU_PATIENCE).withColumns({"rate": F.when(F.col("falls"), F.col("rate") * PLATEAU_FACTOR).otherwise(F.col("rate")), "flat": F.when(F.col("falls"), 0).otherwise(F.col("flat")), "epoch": F.col("epoch") + 1})
    s = s.withColumn("gradient", F.zip_with("gradient", "w", lambda g, w: g + F.col("decay") * w))
    s = s.withColumns({"m": F.zip_with("m", "gradient", lambda m, g: BETAS[0] * m + (1 - BETAS[0]) * g), "v": F.zip_with("v", "gradient", lambda v, g: BETAS[1] * v + (1 - BETAS[1]) * g * g)})
    shrink = lambda beta: F.lit(1.0) - F.pow(F.lit(beta), F.col("epoch"))
    moves = F.zip_with("m", "v", lambda m, v: F.col("rate") * (m / shrink(BETAS[0])) / (F.sqrt(v / shrink(BETAS[1])) + EPSILON))
    s = s.withColumn("w", F.zip_with("w", moves, lambda w, move: w - move))
    s = s.withColumn("done", (F.col("bad") >= F.col("patience")) | F.col("failed"))
    keep = [c for c in state.columns if c not in (by, "weight", "power", "decay", "patience")]
    old = state.select(by, F.struct(*keep).alias("old"))
    s = s.join(old, by)
    return s.select(by, "weight", "power", "decay", "patience", *[F.when(F.col("old.done"), F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in keep])


def _started(rows: DataFrame, hyper: DataFrame, by: str, n: int, patience: int) -> DataFrame:
    """The state before the first epoch: the mean rate and no slopes."""
    start = rows.where(~F.col("held")).groupBy(by).agg((F.sum("count") / F.sum("exposure")).alias("mean"))
    start = rows.select(by).distinct().join(start, by, "left").join(hyper, by, "left")
    w = F.concat(F.array(F.log(F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(1e-6)))), F.array_repeat(F.lit(0.0), n))
    zeros, inf = F.array_repeat(F.lit(0.0), n + 1), F.lit(float("inf"))
    own = {h: F.coalesce(F.col(h), F.lit(d)) for h, d in zip(HYPER, DEFAULTS, strict=True)}
    own["power"] = F.greatest(F.lit(POWERS[0]), F.least(F.lit(POWERS[1]), own["power"]))
    own = [c.alias(h) for h, c in own.items()]
    return start.select(
        by, *own, F.lit(patience).alias("patience"), w.alias("w"), zeros.alias("m"), zeros.alias("v"), w.alias("best_w"), inf.alias("best"), inf.alias("plateau_best"), F.lit(0).alias("bad"), F.lit(0).alias("flat"),
        F.lit(0).alias("epoch"), F.lit(None).cast("double").alias("judged"), F.lit(False).alias("done"),
    )


def train(rows: DataFrame, hyper: DataFrame | None = None, features: Sequence[str] = (), by: str = "species", terms: Mapping[str, float] | None = None, epochs: int = 200, patience: int = PATIENCE, folder: str | None = None) -> DataFrame:
    """by, intercept, a coefficient a feature, loss (the best one of the held rows), epochs and stopped, of a model for each group.

    rows have by, count, exposure, held and the features; expected is exposure * exp(w0 + w . features).
    hyper has by, rate, decay, weight (of the Tweedie term) and power; groups it lacks take DEFAULTS.
    The loss is the sum of `terms` (name to weight) over the rows that aren't held. Adam on all rows
    of a group, a rate that falls where the held loss is flat, an end after `patience` epochs without
    a gain: each group by itself, and the weights of its best epoch count. Rows with a null in any
    column, or without exposure, take no part; a group of held rows alone keeps its start. A `folder`
    in which an earlier run stopped is gone on from.
    """
    spark, terms = rows.sparkSession, dict(terms or {"tweedie": 1.0})
    if unknown := [t for t in terms if t not in TERMS]:
        raise ValueError(f"unknown losses {unknown}; known: {sorted(TERMS)}")
    features = list(features)
    rows = rows.select(by, F.col("count").cast("double").alias("count"), F.col("exposure").cast("double").alias("exposure"), "held", *[F.col(f).cast("double").alias(f) for f in features]).dropna().where("exposure > 0")
    folder = folder or shared_folder(spark, "training")
    rows = kept(rows, "training-rows")  # every epoch passes over them, not over what they are made from
    hyper = hyper if hyper is not None else spark.createDataFrame([], T.StructType([rows.schema[by]] + [T.StructField(h, T.DoubleType()) for h in HYPER]))
    epoch, state = _last(spark, folder)
    if state is None:
        _started(rows, hyper, by, len(features), patience).write.mode("overwrite").parquet(f"{folder}/epoch-0")
        epoch, state = 0, spark.read.parquet(f"{folder}/epoch-0")
    while epoch < epochs and state.where(~F.col("done")).limit(1).count():
        epoch += 1
        to = f"{folder}/epoch-{epoch}"
        _stepped(state, _sums(rows, state, by, features, terms), by).write.mode("overwrite").parquet(to)
        state = spark.read.parquet(to)
        spark.createDataFrame([(epoch,)], "epoch int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/reached")
    return state.select(by, F.element_at("best_w", 1).alias("intercept"), *[F.element_at("best_w", i).alias(f) for i, f in enumerate(features, 2)], F.col("best").alias("loss"), F.col("epoch").alias("epochs"), F.col("done").alias("stopped"))


def _last(spark: SparkSession, folder: str) -> tuple[int, DataFrame | None]:
    """The last epoch that was written whole, and its state."""
    try:
        epoch = spark.read.parquet(f"{folder}/reached").first()[0]
    except AnalysisException:
        return 0, None
    return epoch, spark.read.parquet(f"{folder}/epoch-{epoch}")


def expected(models: DataFrame, rows: DataFrame, features: Sequence[str], by: str = "species") -> DataFrame:
    """rows with expected, the count by the model of each row's group; rows without a model are left out."""
    terms = models.select(by, F.col("intercept").alias("sum_"), *[F.col(f).alias(f"{f}_") for f in features])
    total = sum((F.col(f) * F.col(f"{f}_") for f in features), F.col("sum_"))
    return rows.join(terms, by).withColumn("expected", F.col("exposure") * F.exp(F.greatest(F.lit(-MOST_LOG), F.least(F.lit(MOST_LOG), total)))).select(*rows.columns, "expected")


def skill(predicted: DataFrame, by: str = "species") -> DataFrame:
    """by and r2, the share of the held rows' variance that is explained; null without variance."""
    held = predicted.where("held")
    err = F.sum(F.pow(F.col("count") - F.col("expected"), 2.0))
    return held.groupBy(by).agg((F.lit(1.0) - F.try_divide(err, F.var_pop("count") * F.count("*"))).alias("r2"))
