"""Backfill, assembly and verification frames, and rows that used to end a job."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tallywing.operators import cube, explore, fitting, intervals, scoring, survey
from tallywing.sources import cache, forecasts

T = datetime.datetime


def test_backfill_never_doubles(spark, tmp_path):
    asked, to = [], str(tmp_path / "cache")
    every = spark.range(0, 24 * 800).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("location"), F.timestamp_seconds(F.lit(1577836800) + F.col("id") * 3600).alias("datetime"), F.lit(1.0).alias("v"))

    def fetch(locations, lo, hi):
        asked.append((tuple(locations), lo, hi))
        return every.where(F.col("location").isin(locations) & F.to_date("datetime").between(lo, hi))

    first, middle, last = datetime.date(2020, 3, 1), datetime.date(2021, 6, 1), datetime.date(2022, 2, 1)
    assert cache.backfill(spark, to, ["a"], first, middle, 1, fetch).written == 2
    assert cache.backfill(spark, to, ["a", "b"], first, last, 1, fetch).written == 5  # 2020 of a is complete
    assert (("a",), "2020-01-01", "2020-12-31") not in asked[2:]
    assert cache.backfill(spark, to, ["a", "b"], first, last, 1, fetch).written == 0
    got = cache.load(spark, to, ["a", "b"], ["v"]).groupBy("location", "datetime").count()
    assert got.where("count > 1").count() == 0 and got.count() == 2 * 24 * ((last - datetime.date(2020, 1, 1)).days + 1)


def test_intervals_that_end_before_they_start(spark):
    df = spark.createDataFrame([(1, T(2020, 1, 1, 9, 30), T(2020, 1, 1, 8, 0)), (2, T(2020, 1, 1, 9, 30), T(2020, 1, 1, 10, 30))], "id long, start timestamp, end timestamp")
    assert [r.id for r in intervals.hourly(df).collect()] == [2, 2]
    assert [r.id for r in intervals.sample_instants(df).collect()] == [2, 2, 2]
    assert [r.id for r in survey.suspicious(df).collect()] == [1]


def test_surfaces_of_named_species(spark):
    rows = [(s, d, h, 1 + 0.3 * math.sin(h / 4)) for s in ("kite", "hawk") for d in range(200, 330, 3) for h in range(6, 18)]
    got = fitting.ratio_surfaces(spark.createDataFrame(rows, "species string, doy int, hour int, ratio double"))
    assert dict(got.dtypes)["species"] == "string" and {r.species: r["count"] for r in got.groupBy("species").count().collect()} == {"kite": 366 * 24, "hawk": 366 * 24}


def test_daily_sun_is_refused(spark):
    with pytest.raises(ValueError, match="sun_altitude"):
        forecasts.weather(spark, "Basel", ["temperature_2m", "sun_altitude"], "archive", "daily", start="2020-01-01", end="2020-01-02", lag_days=1)


def test_dates_without_weather_are_an_error(spark):
    rows = spark.createDataFrame([(datetime.date(2020, 1, 1), "train"), (datetime.date(2020, 1, 2), "test")], "date date, tvt string")
    weather = spark.createDataFrame([(datetime.date(2020, 1, 1), 5.0)], "date date, v double")
    assert [r.v for r in explore.assembled(rows, weather, "train").collect()] == [5.0]
    with pytest.raises(ValueError, match="2020-01-02"):
        explore.assembled(rows, weather)
    assert explore.with_weather(rows, weather).count() == 1


def test_frame_of_surveys(spark):
    mask = [0.0] * 24
    mask[7], mask[8] = 0.5, 1.0
    told = [math.log1p(float(h)) for h in range(24)]
    rows = spark.createDataFrame([("kite", 1, datetime.date(2014, 8, 1), 4.0, mask), ("kite", 2, datetime.date(1992, 8, 1), 0.0, [0.0] * 24)], "species string, row long, date date, obs double, mask array<double>")
    pred = spark.createDataFrame([("kite", 1, told), ("kite", 2, told)], "species string, row long, pred_hourly array<double>")
    one, none = scoring.build_frame(rows, pred).orderBy("row").collect()
    assert one.pred == pytest.approx((3.5 + 8) / 1.5) and one.coverage == 1.5 and one.start_hour == 7 and one.era == "2014+"
    assert none.pred is None and none.coverage == 0 and none.start_hour == 0 and none.era == "pre-1993"
    assert explore.day_segments(scoring.build_frame(rows, pred)).select("first_hour", "last_hour").collect() == [(7, 9)]
    with pytest.raises(Exception, match="24 values"):
        scoring.build_frame(rows, pred.withColumn("pred_hourly", F.slice("pred_hourly", 1, 23))).collect()


def test_each_draw_is_found_once(spark):
    df = spark.range(0, 3000).select("id", (F.rand(3) + 1e-9).alias("weight"))
    for seed in (1, 2):
        got = explore.weighted_sample(df, "weight", "id", 500, seed)
        assert got.count() == 500 and got.select("draw").distinct().count() == 500


def test_trial_rows_and_gapless_days(spark):
    df = spark.range(0, 20000)
    some = explore.truncated(df, 0.1, "id")
    assert abs(some.count() - 2000) < 200 and some.exceptAll(explore.truncated(df.repartition(7), 0.1, "id")).count() == 0
    days = spark.createDataFrame([("a", datetime.date(2020, 1, 1), 1.0), ("b", datetime.date(2020, 1, 4), 2.0)], "location string, date date, v double")
    got = cube.gapless(days)
    assert got.count() == 8 and got.where("v is not null").count() == 2 and cube.gapless(days.limit(0)).count() == 0
