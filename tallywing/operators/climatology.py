"""Day-of-year climatologies: statistics, quantiles, smoothing, lookups, hourly rates and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import SEASON, SMOOTH_WINDOW

DAY_HOURS = (6, 17)


def full_grid(stats: DataFrame, first: int = SEASON[0], last: int = SEASON[1]) -> DataFrame:
    """A row for each species and day of year, null where there are no statistics."""
    grid = stats.select("species").distinct().withColumn("doy", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(stats, ["species", "doy"], "left")


def doy_statistics(daily: DataFrame, value: str = "rate") -> DataFrame:
    v = F.col(value)
    return daily.groupBy("species", "doy").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.count_if(v > 0).cast("long").alias("count_observations"))


def doy_quantiles(daily: DataFrame, levels: tuple[int, ...], value: str = "rate") -> DataFrame:
    """species, doy, level and quantile, interpolated linearly."""
    found = daily.groupBy("species", "doy").agg(F.percentile(value, F.array(*[F.lit(x / 100) for x in levels])).alias("q"))
    pairs = F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("level"), F.col("q").alias("quantile"))
    return found.select("species", "doy", F.inline(pairs)).toDF("species", "doy", "level", "quantile")


def smoothed(table: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ("species",), window: int = SMOOTH_WINDOW) -> DataFrame:
    """Centred means over the days of the window that have a value, fewer at the ends."""
    w = W.partitionBy(*by).orderBy("doy").rangeBetween(-(window // 2), window // 2)
    return table.select(*by, "doy", *[F.avg(c).over(w).alias(c) for c in columns])


def clipped_doy(doy: Column, first: int, last: int) -> Column:
    """The first day of a gapless grid not before doy, or its last."""
    return F.greatest(F.lit(first), F.least(doy, F.lit(last)))


def nearest_level(level: float, levels: tuple[int, ...]) -> int:
    """The level nearest to the one asked for, the first of two as near."""
    return min(levels, key=lambda x: abs(x - level))


def hourly_ratio(surveys: DataFrame, daily: DataFrame) -> DataFrame:
    """species, doy, hour and ratio to the day's rate of each survey row, of days with more than one."""
    both = surveys.join(daily.select("species", "date", F.col("rate").alias("daily_rate")), ["species", "date"])
    both = both.withColumn("ratio", F.try_divide("rate", "daily_rate")).withColumn("n", F.count("rate").over(W.partitionBy("species", "date")))
    return both.where((F.col("n") > 1) & F.col("ratio").isNotNull()).select("species", "doy", "hour", "ratio")


def hourly_rate(stats: DataFrame, ratio: DataFrame) -> DataFrame:
    """Mean rate times the ratio of each hour by day, 0 at night; stats (species, doy, mean), ratio (species, hour, ratio)."""
    hours = stats.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).join(ratio, ["species", "hour"], "left")
    day = F.col("hour").between(*DAY_HOURS)
    return hours.select("species", "doy", "hour", F.when(day, F.coalesce(F.col("ratio") * F.col("mean"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("rate"))


def shape_lines(shapes: DataFrame, by: tuple[str, ...] = ("species",)) -> DataFrame:
    """The shapes of the first, the middle and the last day of year, tagged."""
    days = shapes.groupBy(*by).agg(F.array_sort(F.collect_set("doy")).alias("all_"))
    middle = F.get("all_", F.floor(F.size("all_") / 2).cast("int"))
    tags = days.select(*by, F.explode(F.array(*[F.struct(F.lit(t).alias("line"), d.alias("doy")) for t, d in (("first", F.get("all_", F.lit(0))), ("middle", middle), ("last", F.element_at("all_", -1)))])).alias("t"))
    return shapes.join(tags.select(*by, "t.line", "t.doy"), [*by, "doy"])


def hourly_shape(rates: DataFrame, night: DataFrame) -> DataFrame:
    """Rates with the hours of night (doy, hour, night; 8 784 rows at most) at 0, scaled to sum to 1 a day; a day without rate is even over the day's hours."""
    dark = rates.join(F.broadcast(night), ["doy", "hour"], "left").withColumn("rate", F.when(F.coalesce("night", F.lit(False)), F.lit(0.0)).otherwise(F.col("rate")))
    total = F.sum("rate").over(W.partitionBy("species", "doy"))
    even = F.when(F.col("hour").between(*DAY_HOURS), F.lit(1.0 / (DAY_HOURS[1] - DAY_HOURS[0] + 1))).otherwise(F.lit(0.0))
    return dark.select("species", "doy", "hour", F.when(total > 0, F.col("rate") / total).otherwise(even).alias("shape"))
