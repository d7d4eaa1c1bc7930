"""Summaries, samples and splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def spread_of_days(frame: DataFrame, n: int) -> DataFrame:
    """species, date and tag: the n / 2 days of most birds, and as many of the rest in an order fixed by the date."""
    days = frame.groupBy("species", "date").agg(F.avg("obs").alias("m"))
    days = days.withColumn("k", F.row_number().over(W.partitionBy("species").orderBy(F.desc("m"), "date")))
    place = F.datediff("date", F.lit("1970-01-01").cast("date")) * 7919 % 1009
    rest = days.where(F.col("k") > n // 2).withColumn("j", F.row_number().over(W.partitionBy("species").orderBy(place, "date")))
    top = days.where(F.col("k") <= n // 2).select("species", "date", F.lit("busiest").alias("tag"))
    return top.unionByName(rest.where(F.col("j") <= n - n // 2).select("species", "date", F.lit("sampled").alias("tag")))


def years_split(years_by_era: dict[str, list[int]], shares: tuple[float, float] = (0.7, 0.9), seed: int = 0) -> dict[int, str]:
    """train, val or test for each year: years of an era are shuffled and cut at the shares, rounded down."""
    rng, out = np.random.default_rng(seed), {}
    for era in sorted(years_by_era):
        years = sorted(years_by_era[era])
        rng.shuffle(years)
        a, b = (int(len(years) * s) for s in shares)
        out |= {y: "train" if i < a else "val" if i < b else "test" for i, y in enumerate(years)}
    return out


def keyed_years_split(years: DataFrame, shares: tuple[float, float] = (0.7, 0.9)) -> DataFrame:
    """year, era and tvt: as years_split, in an order fixed by the year's number."""
    w = W.partitionBy("era").orderBy(F.col("year") * 7919 % 101, "year")
    ranked = years.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy("era")))
    a, b = (F.floor(F.col("n") * s) for s in shares)
    return ranked.select("year", "era", F.when(F.col("i") < a, "train").when(F.col("i") < b, "val").otherwise("test").alias("tvt"))


def keyed_split(key: Column, shares: tuple[float, float] = (0.7, 0.9)) -> Column:
    """train, val or test from an integer key of the row, the same in every run."""
    place = F.pmod(key * 2654435761 % 1_000_003, F.lit(1000))
    return F.when(place < int(shares[0] * 1000), "train").when(place < int(shares[1] * 1000), "val").otherwise("test")


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("tvt").agg(
        F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.countDistinct("year").alias("n_years"),
        F.avg((F.col("count") == 0).cast("double")).alias("zero_share"), F.avg("duration").alias("mean_duration"),
    )


def split_by_era(df: DataFrame, eras: tuple[str, ...]) -> DataFrame:
    """Rows of each split by era."""
    return df.groupBy("tvt").pivot("era", list(eras)).agg(F.count(F.lit(1))).fillna(0)


def assembled(rows: DataFrame, weather: DataFrame, split: str | None = None) -> DataFrame:
    """Survey rows beside the weather of their date, of one split if given; a date without weather is an error.

    weather: one row a date. Rows of other splits don't count.
    """
    rows = rows if split is None else rows.where(F.col("tvt") == split)
    lacking = rows.select("date").distinct().join(weather.select("date"), "date", "left_anti").orderBy("date").limit(5).collect()
    if lacking:
        raise ValueError(f"no weather on {', '.join(str(r['date']) for r in lacking)}")
    return rows.join(weather, "date")


def with_weather(rows: DataFrame, weather: DataFrame) -> DataFrame:
    """Rows of dates that have weather, beside it: what can be predicted of the dates asked for."""
    return rows.join(weather, "date")


def truncated(df: DataFrame, share: float, *key: str) -> DataFrame:
    """About this share of the rows, the same ones in every run, for short trial runs."""
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1_000_000)) < int(share * 1_000_000))


def day_segments(frame: DataFrame) -> DataFrame:
    """species, date, row, first_hour, last_hour (exclusive) and obs of each survey that has watched an hour."""
    watched = F.transform("mask", lambda m: m > 0)
    first = F.array_position(watched, True) - 1
    last = F.size("mask") - F.array_position(F.reverse(watched), True) + 1
    # both hours leave a list of one, past which Spark moves no filter: the mask is made once, not once more for the filter
    hours = F.explode(F.array(F.struct(first.alias("first"), last.alias("last")))).alias("hours")
    found = frame.select("species", "date", "row", "obs", hours).where(F.col("hours.first") >= 0)
    return found.select("species", "date", "row", F.col("hours.first").alias("first_hour"), F.col("hours.last").alias("last_hour"), "obs")


def day_coverage(frame: DataFrame) -> DataFrame:
    """species, date, hour and coverage, the watched part of each hour over all surveys of the day, 1 at most."""
    hours = frame.select("species", "date", F.posexplode("mask").alias("hour", "mask")).where(F.col("mask") > 0)
    return hours.groupBy("species", "date", "hour").agg(F.least(F.sum("mask"), F.lit(1.0)).alias("coverage"))


def year_by_doy(df: DataFrame, value: Column, days: tuple[int, int] = (1, 366), empty: float | None = None) -> DataFrame:
    """year and a column d1, d2, ... a day of year with an aggregate of its rows; `empty` where there are none."""
    all_days = list(range(days[0], days[1] + 1))
    out = df.groupBy("year").pivot("doy", all_days).agg(value)
    out = out.select("year", *[F.col(str(d)).alias(f"d{d}") for d in all_days])
    return out if empty is None else out.fillna(empty)


def histogram(df: DataFrame, value: str, bins: int = 59) -> DataFrame:
    """bin (from 1) and n over `bins` equal bins from 0 to the greatest value, which the last bin holds."""
    top = df.agg(F.max(value).alias("top"))
    placed = df.crossJoin(F.broadcast(top)).select(F.when(F.col("top") > 0, F.least(F.floor(F.col(value) / F.col("top") * bins) + 1, F.lit(bins))).otherwise(F.lit(1)).cast("long").alias("bin"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))


def top_rates(df: DataFrame, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc("rate"), *ties).limit(n)


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """n draws with replacement from each group of `by`, each row as often as its weight asks for.

    Draws are points on the running sum of weights; each range of it finds its own, so that only
    the sums of ranges are ordered together.
    """
    parts = df.withColumn("part_", F.pmod(F.xxhash64(key), F.lit(256)))
    sums = parts.groupBy(*by, "part_").agg(F.sum(weight).alias("w_"))
    before = sums.withColumn("before_", F.coalesce(F.sum("w_").over(W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    totals = sorted(before.groupBy(*by).agg(F.sum("w_").alias("w_")).where("w_ > 0").collect(), key=lambda r: [str(r[c]) for c in by])
    if not totals:
        return df.limit(0).withColumn("draw", F.lit(0))
    rng, kind = np.random.default_rng(seed), StructType([df.schema[c] for c in by]).add("draw", "integer").add("at", "double")
    points = df.sparkSession.createDataFrame([(*r[:-1], i, float(x)) for r in totals for i, x in enumerate(rng.random(n) * r["w_"])], kind)
    # a row's points run from the end of the row before it to its own; the last of a range takes what rounding leaves
    ordered = W.partitionBy(*by, "part_").orderBy(key)
    placed = parts.withColumn("to_", F.sum(weight).over(ordered.rowsBetween(W.unboundedPreceding, 0))).join(before, [*by, "part_"]).withColumn("to_", F.col("to_") + F.col("before_"))
    placed = placed.withColumns({"from_": F.coalesce(F.lag("to_").over(ordered), F.lit(float("-inf"))), "to_": F.when(F.lead(key).over(ordered).isNull(), F.lit(float("inf"))).otherwise(F.col("to_"))})
    inside = (points["at"] >= before["before_"]) & (points["at"] < before["before_"] + before["w_"])
    for c in by:
        inside &= points[c] == before[c]
    home = points.join(before if by else F.broadcast(before), inside).select(*[points[c] for c in by], "draw", "at", "part_")
    hit = placed.join(home, [*by, "part_"]).where((F.col("at") < F.col("to_")) & (F.col("at") >= F.col("from_")))
    return hit.select(*df.columns, "draw")


def mean_attribution(df: DataFrame, axis: str, value: str = "attribution") -> DataFrame:
    return df.groupBy(axis).agg(F.avg(F.abs(value)).alias("attribution"))


def years_range(years: Column) -> Column:
    """The years of a group as text: one year, or first-last."""
    return F.when(F.min(years) == F.max(years), F.min(years).cast("string")).otherwise(F.format_string("%d-%d", F.min(years), F.max(years)))
