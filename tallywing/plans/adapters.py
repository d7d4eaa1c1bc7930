"""The driver tables as surveys, intervals, station hours and surrogate predictions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import survey

ERA_EDGES = (1997, 2000)
ERA_LABELS = ("early", "middle", "late")
STATIONS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """species, date, hour and count of hour-long surveys."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 11).cast("int").alias("species"), F.to_date("l_shipdate").alias("date"), (F.col("l_linenumber") + 5).cast("int").alias("hour"), F.col("l_quantity").alias("count")
    )
    return survey.summed(rows, ("species", "date", "hour"))


def hour_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """species, date, hour, count, duration, rate, doy and year of every species and survey hour, zeros filled in."""
    filled = survey.zero_fill(hour_counts(spark, sf_dir), by=("date", "hour"))
    filled = survey.with_rate(filled, F.lit(1.0))
    return filled.withColumn("doy", F.dayofyear("date")).withColumn("year", F.year("date"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """species, date, doy, year, count, duration and rate by day."""
    return survey.daily_rate(hour_surveys(spark, sf_dir), ("species", "date", "doy", "year"))


HOURS = """
cnt AS (SELECT (l_suppkey % 11)::INT AS species, l_shipdate::DATE AS date, (l_linenumber + 5)::INT AS hour, sum(l_quantity) AS n FROM lineitem GROUP BY ALL),
per AS (SELECT DISTINCT date, hour FROM cnt), spp AS (SELECT DISTINCT species FROM cnt),
hs AS (SELECT s.species, p.date, p.hour, coalesce(c.n, 0) AS count, 1.0::DOUBLE AS duration, coalesce(c.n, 0) / 1.0::DOUBLE AS rate, dayofyear(p.date)::INT AS doy, year(p.date)::INT AS year
       FROM per p CROSS JOIN spp s LEFT JOIN cnt c ON c.species = s.species AND c.date = p.date AND c.hour = p.hour),
dy AS (SELECT species, date, doy, year, sum(count) AS count, sum(duration) AS duration, sum(count) / nullif(sum(duration), 0) AS rate FROM hs GROUP BY ALL)"""


def intervals(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """id, species, date, start, end and count of surveys of uneven length, and more of their orders by name."""
    o = table(spark, sf_dir, "orders")
    first = F.lit(240) + 60 * (F.col("o_orderkey") % 12) + 15 * (F.col("o_custkey") % 4)
    long = 15 * (1 + F.col("o_orderkey") % 29)
    day = F.to_date("o_orderdate").cast("timestamp")
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"), F.lit(0))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("species"), F.to_date("o_orderdate").alias("date"),
        (day + minutes(first)).alias("start"), (day + minutes(first + long)).alias("end"), (F.col("o_custkey") % 5).cast("double").alias("count"),
        *[c.alias(name) for name, c in more.items()],
    )


INTERVALS = """
iv AS (SELECT o_orderkey AS id, o_orderpriority AS species, o_orderdate::DATE AS date, (240 + 60 * (o_orderkey % 12) + 15 * (o_custkey % 4))::BIGINT AS s, (15 * (1 + o_orderkey % 29))::BIGINT AS len, (o_custkey % 5)::DOUBLE AS count FROM orders),
ti AS (SELECT *, s + len AS e FROM iv)"""


def minute_of(ts: str):
    """Minutes after midnight."""
    return (F.hour(ts) * 60 + F.minute(ts)).cast("long")


def station_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """location, date, hour, v1 (a state), v2 (an accumulation) and dir of stations' hours."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("location"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(
        F.avg("value").alias("v1"), F.sum("value").alias("v2"), (F.sum("user_id") % 360).cast("double").alias("dir")
    )


STATION = """
wx AS (SELECT event_type AS location, ts::DATE AS date, hour(ts)::INT AS hour, avg(value) AS v1, sum(value) AS v2, (sum(user_id) % 360)::DOUBLE AS dir FROM events GROUP BY ALL)"""
DENSE = (
    STATION
    + """,
cube AS (SELECT l.location, d.date, h.hour, wx.v1, wx.v2, wx.dir FROM (SELECT DISTINCT location FROM wx) l CROSS JOIN (SELECT DISTINCT date FROM wx) d CROSS JOIN (SELECT DISTINCT hour FROM wx) h
         LEFT JOIN wx ON wx.location = l.location AND wx.date = d.date AND wx.hour = h.hour)"""
)


def era_column():
    from ..functions.time import era_of

    return era_of(F.col("year"), ERA_EDGES, ERA_LABELS)


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey rows with a surrogate prediction: the species' mean by day of year, swung by weekday and hour."""
    hs = hour_surveys(spark, sf_dir)
    clim = daily(spark, sf_dir).groupBy("species", "doy").agg(F.avg("rate").alias("phen"))
    day_part = 1 + (F.col("doy") % 7 - 3) / F.lit(10.0)
    rows = hs.join(clim, ["species", "doy"])
    return rows.select(
        "species", "date", "hour", "doy", "year", era_column().alias("era"), F.col("rate").alias("obs"), (F.col("phen") * day_part * (1 + (F.col("hour") % 5) / F.lit(10.0))).alias("pred"),
        F.lit(1.0).alias("coverage"), "phen",
    )


EVALUATION = (
    HOURS
    + """,
clim AS (SELECT species, doy, avg(rate) AS phen FROM dy GROUP BY ALL),
ev AS (SELECT hs.species, date, hour, doy, year, CASE WHEN year < 1997 THEN 'early' WHEN year < 2000 THEN 'middle' ELSE 'late' END AS era, rate AS obs,
       phen * (1 + (doy % 7 - 3) / 10.0::DOUBLE) * (1 + (hour % 5) / 10.0::DOUBLE) AS pred, 1.0::DOUBLE AS coverage, phen FROM hs JOIN clim USING (species, doy)),
df0 AS (SELECT species, date, any_value(doy) AS doy, any_value(year) AS year, any_value(era) AS era, any_value(phen) AS phen, sum(obs * coverage) / nullif(sum(coverage), 0) AS obs, sum(pred * coverage) / nullif(sum(coverage), 0) AS pred, sum(coverage) AS coverage, count(*) AS n_rows FROM ev GROUP BY species, date),
df AS (SELECT a.*, b.obs AS persistence FROM df0 a LEFT JOIN df0 b ON a.species = b.species AND b.date = a.date - 1),
thr AS (SELECT species, doy, quantile_cont(rate, 0.9) AS threshold FROM dy GROUP BY ALL)"""
)


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).groupBy("species", "doy").agg(F.percentile("rate", F.lit(0.9)).alias("threshold"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


def written(df: DataFrame, *dates: str) -> DataFrame:
    """Dates as text, integers as longs: the same types in every engine."""
    for c, kind in df.dtypes:
        if c in dates or kind == "date":
            df = df.withColumn(c, F.col(c).cast("string"))
        elif kind in ("int", "smallint"):
            df = df.withColumn(c, F.col(c).cast("long"))
    return df
