"""Survey counts: zero-filling, rates, coverage, daily frames and cleaning of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import hours_between

PERIOD = ("date", "start", "end")


def periods(counts: DataFrame, by: tuple[str, ...] = PERIOD) -> DataFrame:
    """The distinct survey periods, whatever was counted in them."""
    return counts.select(*by).distinct()


def summed(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counts summed by key; rows with a null key go, as their group would be nobody's."""
    return counts.dropna(subset=list(by)).groupBy(*by).agg(F.sum("count").alias("count"))


def zero_fill(counts: DataFrame, species: DataFrame | None = None, by: tuple[str, ...] = PERIOD) -> DataFrame:
    """One row for each species and survey period, with count 0 where the species has none.

    species: a table of the species column; those of counts if not given, a null one left out. A
    period gathers its own counts by species, as many as there are species at most, and makes its
    rows from them and the list of all species, so that only counts are moved, never the filled rows.
    A period with a null in its key has no counts.
    """
    every = (counts if species is None else species).agg(F.collect_set("species")).scalar()
    known = F.col("species").isNotNull()
    for c in by:
        known &= F.col(c).isNotNull()
    own = counts.groupBy(*by, "species").agg(F.sum("count").alias("count")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(known, F.struct("species", "count")))).alias("own_"))
    kind = counts.select(F.sum("count")).schema[0].dataType
    rows = own.withColumn("every_", every).select(*by, "own_", F.explode("every_").alias("species"))
    return rows.select("species", *by, F.coalesce(F.try_element_at("own_", F.col("species")), F.lit(0).cast(kind)).alias("count"))


def with_rate(df: DataFrame, duration: Column | None = None) -> DataFrame:
    """Adds duration in hours and the hourly rate; a period without duration has no rate."""
    duration = hours_between(F.col("start"), F.col("end")) if duration is None else duration
    return df.withColumn("duration", duration).withColumn("rate", F.when(F.col("duration") > 0, F.col("count") / F.col("duration")))


def daily_rate(df: DataFrame, by: tuple[str, ...] = ("species", "date")) -> DataFrame:
    """The count of a day over its survey hours."""
    return df.groupBy(*by).agg(F.sum("count").alias("count"), F.sum("duration").alias("duration")).withColumn("rate", F.try_divide("count", "duration"))


def daily_frame(frame: DataFrame, by: tuple[str, ...] = ("species",)) -> DataFrame:
    """obs and pred of a day weighted by coverage, with the observation of the day before, if there is one."""
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("coverage")), F.sum("coverage")).alias(c)
    extra = [F.first(c).alias(c) for c in ("doy", "year", "era", "phen") if c in frame.columns]
    daily = frame.groupBy(*by, "date").agg(weighted("obs"), weighted("pred"), F.sum("coverage").alias("coverage"), F.count("*").alias("n_rows"), *extra)
    return with_persistence(daily, by)


def with_persistence(daily: DataFrame, by: tuple[str, ...] = ("species",), value: str = "obs") -> DataFrame:
    """Adds the value of the day before, null where that day isn't in the table; a group has a row a date."""
    w = W.partitionBy(*by).orderBy("date")
    return daily.withColumn("persistence", F.when(F.lag("date").over(w) == F.date_sub("date", 1), F.lag(value).over(w)))


def clamped_time(seen: Column, start: Column, end: Column, slack: str = "10 minutes") -> Column:
    """A sighting a little before its period moves to a minute after its start, one a little after to a minute before its end."""
    slack, minute = F.expr(f"INTERVAL {slack}"), F.expr("INTERVAL 1 MINUTE")
    return F.when((seen < start) & (seen >= start - slack), start + minute).when((seen > end) & (seen <= end + slack), end - minute).otherwise(seen)


def inside_period(seen: Column, start: Column, end: Column) -> Column:
    """Whether a sighting lies in its period; one without a time does."""
    return ~F.coalesce((seen < start) | (seen > end), F.lit(False))


def period_statistics(records: DataFrame, by: tuple[str, ...] = PERIOD, seen: str = "seen") -> DataFrame:
    """Of each period the number of records, those without a time, their share, its duration, and the periods of the day."""
    out = records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(seen).isNull()).alias("n_untimed"))
    out = out.withColumn("untimed_share", F.col("n_untimed") / F.col("n")).withColumn("duration", hours_between(F.col("start"), F.col("end")))
    per_day = out.groupBy("date").agg(F.countDistinct("start").alias("periods_of_day"))
    return out.join(per_day, "date")


def expandable(stats: DataFrame) -> DataFrame:
    """Periods of over two hours with fewer than half of their records untimed."""
    return stats.where((F.col("duration") > 2) & (F.col("untimed_share") < 0.5))


def long_enough(df: DataFrame, minutes: int = 10) -> DataFrame:
    return df.where(hours_between(F.col("start"), F.col("end")) >= minutes / 60)


def suspicious(df: DataFrame, most_hours: float = 15.0, day_start: str | None = None, day_end: str | None = None) -> DataFrame:
    """Periods that end before they start, or last too long, or leave the hours of their day where its columns are given."""
    odd = (F.col("start") >= F.col("end")) | (hours_between(F.col("start"), F.col("end")) > most_hours)
    if day_start:
        odd |= F.col("start") < F.col(day_start)
    if day_end:
        odd |= F.col("end") > F.col(day_end)
    return df.where(odd)


def without_untimed(records: DataFrame, expanded: DataFrame, by: tuple[str, ...] = PERIOD, seen: str = "seen") -> DataFrame:
    """Records but those without a time in the periods that are expanded to hours: nothing says in which hour they belong."""
    at = expanded.select(*by).distinct().withColumn("expanded_", F.lit(True))
    return records.join(at, list(by), "left").where(F.col(seen).isNotNull() | F.col("expanded_").isNull()).drop("expanded_")


def same_interval(left: DataFrame, right: DataFrame, keep: bool = True, by: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """Rows of left whose exact interval right has too, or with keep=False has not: periods noted as without birds are only so where nothing was counted."""
    return left.join(right.select(*by).distinct(), list(by), "left_semi" if keep else "left_anti")


def kept_taxa(taxonomy: DataFrame, families: tuple[str, ...], category: str = "species") -> DataFrame:
    """Entries of the taxonomy of one of the families and of the category."""
    return taxonomy.where(F.col("family").isin(list(families)) & (F.col("category") == category))


def merged_species(records: DataFrame, taxonomy: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Records of species that the taxonomy maps are summed by key under its name; others stay as they are."""
    named = records.join(taxonomy.select("species", "name"), "species", "left")
    mapped = summed(named.where(F.col("name").isNotNull()).drop("species").withColumnRenamed("name", "species"), ("species", *by))
    return mapped.unionByName(named.where(F.col("name").isNull()).select("species", *by, "count"))


def with_taxonomy(df: DataFrame, taxonomy: DataFrame, key: str = "species") -> DataFrame:
    """df with the taxonomy's columns; a key that the taxonomy holds twice is an error, as rows would multiply."""
    if taxonomy.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"the taxonomy has a {key} twice")
    return df.join(taxonomy, key, "left")
