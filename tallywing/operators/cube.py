"""Hourly station cubes: densifying, daily rollup, calendar lags, completeness, normalisation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("location", "date", "hour")


def dense(long: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """A row for each combination of the axes' values, null where the table has none; the axes are short."""
    grid = None
    for a in axes:
        values = long.select(a).distinct()
        grid = values if grid is None else grid.crossJoin(values)
    return grid.join(long, list(axes), "left")


def checked_unique(long: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    if long.groupBy(*axes).count().where("count > 1").limit(1).count():
        raise ValueError(f"a cell of {axes} is there twice")
    return long


def daily(long: DataFrame, how: Mapping[str, str], by: tuple[str, ...] = ("location", "date")) -> DataFrame:
    """Sums or means over the hours of a day; the sum of a day without any value is 0."""
    aggs = [(F.coalesce(F.sum(v), F.lit(0.0)) if h == "sum" else F.avg(v)).alias(v) for v, h in how.items()]
    return long.groupBy(*by).agg(*aggs)


def gapless(days: DataFrame, by: tuple[str, ...] = ("location",)) -> DataFrame:
    """A row for each group and calendar day from the first to the last of the table, null where the table has none."""
    span = days.agg(F.when(F.min("date").isNotNull(), F.sequence(F.min("date"), F.max("date")))).scalar()
    every = days.select(*by).distinct().withColumn("span_", span).select(*by, F.explode("span_").alias("date"))
    return every.join(days, [*by, "date"], "left")


def lags(days: DataFrame, n: int, values: tuple[str, ...]) -> DataFrame:
    """For each location and date of the table the values of the same date and of the n - 1 days before.

    A day that isn't in the table gives nulls: lags are calendar days, not rows.
    """
    keys = days.select("location", "date").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("from_", F.date_sub("date", F.col("lag")))
    source = days.select("location", F.col("date").alias("from_"), *values)
    return keys.join(source, ["location", "from_"], "left").drop("from_")


def complete_dates(cube: DataFrame, values: tuple[str, ...], n_cells: int) -> DataFrame:
    """Dates of which every one of the n_cells rows is there with every value."""
    full = F.lit(True)
    for v in values:
        full &= F.col(v).isNotNull()
    return cube.groupBy("date").agg(F.count_if(full).alias("n")).where(F.col("n") == n_cells).select("date")


def keep_complete(cube: DataFrame, values: tuple[str, ...], n_cells: int) -> DataFrame:
    return cube.join(complete_dates(cube, values, n_cells), "date", "left_semi")


def fit_transforms(long: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """variable, kind, p1 and p2 of each variable, fitted over the whole table in one pass.

    standardize: mean and deviation; log_standardize: the same of the logarithm, clipped at 1e-9;
    minmax: least and greatest.
    """
    aggs = []
    for v, kind in kinds.items():
        x = F.log(F.greatest(F.col(v), F.lit(1e-9))) if kind == "log_standardize" else F.col(v)
        p = (F.min(x), F.max(x)) if kind == "minmax" else (F.avg(x), F.stddev_pop(x))
        aggs.append(F.struct(F.lit(v).alias("variable"), F.lit(kind).alias("kind"), p[0].cast("double").alias("p1"), p[1].cast("double").alias("p2")))
    return long.agg(F.array(*aggs).alias("all")).select(F.inline("all"))


def apply_transforms(long: DataFrame, params: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """Normalised variables; one without parameters passes through. The table of parameters has a row a variable."""
    known = {r["variable"]: r for r in params.where(F.col("variable").isin(list(variables))).collect()}
    for v in variables:
        if v in known:
            kind, p1, p2 = known[v]["kind"], F.lit(known[v]["p1"]), F.lit(known[v]["p2"])
            x = F.log(F.greatest(F.col(v), F.lit(1e-9))) if kind == "log_standardize" else F.col(v)
            long = long.withColumn(v, F.try_divide(x - p1, p2 - p1 if kind == "minmax" else p2))
    return long


def parity(left: DataFrame, right: DataFrame, on: tuple[str, ...], variables: tuple[str, ...], least_dates: int = 20) -> DataFrame:
    """Bias, ratio of deviations and correlation of each variable over the cells that two sources share.

    Fewer shared dates than asked for give no rows.
    """
    both = left.select(*on, *[F.col(v).alias(f"{v}_l") for v in variables]).join(right.select(*on, *[F.col(v).alias(f"{v}_r") for v in variables]), list(on))
    stacked = both.select("date", F.inline(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_l").alias("l"), F.col(f"{v}_r").alias("r")) for v in variables])))
    out = stacked.where(F.col("l").isNotNull() & F.col("r").isNotNull()).groupBy("variable").agg(
        F.countDistinct("date").alias("n_dates"), F.avg(F.col("r") - F.col("l")).alias("bias"),
        F.try_divide(F.stddev_pop("r"), F.stddev_pop("l")).alias("std_ratio"), F.corr("l", "r").alias("corr"),
    )
    return out.where(F.col("n_dates") >= least_dates)
