"""Ranks, quantiles and next known keys of groups of any size: values are dealt out by range, and counts carried over the edges.

No task sees a whole group. Rows that share a value are counted before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.cache import shared_folder

#: A value with more than this share of all rows is sent to them, not they to it; there are 1 / HEAVY such values at most.
HEAVY, SALTS = 1 / 1000, 1024


def _met(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are equal, each column of `on` once."""
    right = right.withColumnsRenamed({c: f"{c}_right_" for c in on})
    same = [left[c].eqNullSafe(right[f"{c}_right_"]) for c in on]
    return left.join(right, same, how).drop(*[f"{c}_right_" for c in on])


def _placed(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with part_, the number of its range; written once, since ranges are drawn anew in every run."""
    spark = df.sparkSession
    to = shared_folder(spark, "ranges")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *by, *order).withColumn("part_", F.spark_partition_id()).write.parquet(to)
    return spark.read.parquet(to)


def cumulative(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, n (rows that have it), below (rows of the group with smaller values) and total (rows of the group).

    Null values don't count; NaN comes last. A null in `by` is a group.
    """
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = _placed(counted, by, [value])
    group, part = W.partitionBy(*by), W.partitionBy(*by, "part_").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    parts = placed.groupBy(*by, "part_").agg(F.sum("n").alias("m"))  # as many rows a group as there are ranges
    edges = parts.select(*by, "part_", (F.sum("m").over(group.orderBy("part_").rowsBetween(W.unboundedPreceding, 0)) - F.col("m")).alias("before_"), F.sum("m").over(group).alias("total"))
    inside = placed.withColumn("inside_", F.sum("n").over(part) - F.col("n"))
    return _met(inside, edges, [*by, "part_"]).select(*by, value, "n", (F.col("before_") + F.col("inside_")).alias("below"), "total")


def with_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the rank of its value in its group, ties at their mean; null for a null value."""
    by, spark = list(by), df.sparkSession
    to = shared_folder(spark, "ranks")
    cumulative(df, by, value).select(*by, value, (F.col("below") + (F.col("n") + 1) / 2).alias("rank_"), "n").write.parquet(to)
    ranks = spark.read.parquet(to)
    rows = ranks.agg(F.sum("n")).first()[0] or 0
    heavy = ranks.where(F.col("n") > rows * HEAVY).select(*by, value, F.col("rank_").alias("heavy_"))
    met = _met(df, F.broadcast(heavy), [*by, value], "left")
    part = F.when(F.col("heavy_").isNull() & F.col(value).isNotNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    light = ranks.where(F.col("n") <= rows * HEAVY).select(*by, value, "rank_", F.lit(0).cast("long").alias("salt_"))
    met = _met(met.withColumn("salt_", part), light, [*by, value, "salt_"], "left")
    return met.select(*df.columns, F.coalesce("heavy_", "rank_").alias(name))


def quantiles(df: DataFrame, by: Sequence[str], value: str, levels: Sequence[float]) -> DataFrame:
    """by, level and quantile: the exact quantiles of each group at these levels (per cent), interpolated linearly.

    Found by counting: a quantile lies between the values at two places, and the place of every value
    is known. Null and NaN values don't count; a group of these alone has no rows.
    """
    by = list(by)
    counts = cumulative(df.where(~F.isnan(F.col(value).cast("double"))), by, value)
    at = lambda x: (F.col("total") - 1) * F.lit(x / 100)
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
    entry = lambda x: F.struct(F.lit(float(x)).alias("level"), (at(x) - F.floor(at(x))).alias("share"), holds(F.floor(at(x))).alias("low"), holds(F.ceil(at(x))).alias("high"))
    met = counts.select(*by, F.col(value).cast("double").alias("v_"), F.explode(F.filter(F.array(*[entry(x) for x in levels]), lambda e: e.low | e.high)).alias("e"))
    found = met.groupBy(*by, F.col("e.level").alias("level")).agg(F.max(F.when(F.col("e.low"), F.col("v_"))).alias("low"), F.max(F.when(F.col("e.high"), F.col("v_"))).alias("high"), F.max("e.share").alias("share"))
    return found.select(*by, "level", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("quantile"))


def with_next(df: DataFrame, grid: DataFrame, by: Sequence[str], at: str, name: str = "known") -> DataFrame:
    """df with the smallest key of its group in grid that is not below its own, or the group's largest where there is none.

    grid has `by` and `at`; its keys may have holes and repeat. A row without a key, or of a group
    that the grid lacks, gets null. Only distinct keys are ordered; they go back to the rows by key.
    """
    by = list(by)
    keys = grid.where(F.col(at).isNotNull()).select(*by, at, F.lit(True).alias("is_known_")).unionByName(df.where(F.col(at).isNotNull()).select(*by, at, F.lit(False).alias("is_known_")))
    placed = _placed(keys.groupBy(*by, at).agg(F.max("is_known_").alias("is_known_")), by, [at])
    own = F.when(F.col("is_known_"), F.col(at))
    ahead = W.partitionBy(*by, "part_").orderBy(at).rowsBetween(0, W.unboundedFollowing)
    edges = placed.groupBy(*by, "part_").agg(F.min(own).alias("first_"), F.max(own).alias("last_"))
    later = W.partitionBy(*by).orderBy("part_").rowsBetween(1, W.unboundedFollowing)
    edges = edges.select(*by, "part_", F.min("first_").over(later).alias("later_"), F.max("last_").over(W.partitionBy(*by)).alias("end_"))
    found = _met(placed.withColumn("here_", F.min(own).over(ahead)), edges, [*by, "part_"]).select(*by, at, F.coalesce("here_", "later_", "end_").alias(name))
    return _met(df, found, [*by, at], "left")


def rank_correlation(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """by and spearman, the correlation of the ranks of x and y in each group, over rows that have both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = with_rank(with_rank(both, by, x, "rank_x_"), by, y, "rank_y_")
    return ranked.groupBy(*by).agg(F.corr("rank_x_", "rank_y_").alias("spearman"))
