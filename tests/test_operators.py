import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing import registry
from tallywing.functions import scores
from tallywing.functions.time import clock_hours, coverage_mask, local_to_utc, parsed_time
from tallywing.functions.weather import wind_components
from tallywing.operators import climatology, cube, explore, fitting, intervals, scoring, survey
from tallywing.plans.weather_plans import night_mask
from tallywing.sources import cache, forecasts, records

T = datetime.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("direction, expected", [(0, (0, -10)), (90, (-10, 0)), (180, (0, 10)), (270, (10, 0))])
def test_wind_blows_from(spark, direction, expected):
    u, v = wind_components(F.lit(10.0), F.lit(float(direction)))
    assert one(spark, u) == pytest.approx(expected[0], abs=1e-9) and one(spark, v) == pytest.approx(expected[1], abs=1e-9)


@pytest.mark.parametrize("name, given, expected", [("temperature_2m", 20.0, 293.15), ("surface_pressure", 900.0, 90000.0), ("total_precipitation", 5.0, 0.005), ("total_cloud_cover", 100.0, 1.0), ("surface_solar_radiation_downwards", 100.0, 360000.0)])
def test_units(spark, name, given, expected):
    assert one(spark, registry.VARIABLES[name].convert(F.lit(given))) == pytest.approx(expected)


def test_guards():
    with pytest.raises(ValueError):
        registry.checked_locations(["Atlantis"])
    with pytest.raises(ValueError):
        registry.checked_variables(["luck"])
    with pytest.raises(ValueError):
        registry.checked_variables(["convective_available_potential_energy"], "archive")
    assert registry.request_parameters("u_component_of_wind_10m")["hourly"] == "wind_speed_10m,wind_direction_10m"
    assert all(40 < lat < 60 and -5 < lon < 25 for lat, lon in registry.LOCATIONS.values()) and len(registry.LOCATIONS) == 13


@pytest.mark.parametrize("start, end, expected", [(9.5, 12.25, {9: 0.5, 10: 1, 11: 1, 12: 0.25}), (10.25, 10.75, {10: 0.75})])
def test_coverage_mask(spark, start, end, expected):
    assert {h: m for h, m in enumerate(one(spark, coverage_mask(F.lit(start), F.lit(end)))) if m} == expected


def test_exact_mask_and_midnight(spark):
    assert one(spark, coverage_mask(F.lit(10.25), F.lit(10.75), exact=True))[10] == 0.5
    mask = coverage_mask(clock_hours(F.lit(T(2020, 1, 1, 23))), clock_hours(F.lit(T(2020, 1, 2, 1))))
    assert sum(one(spark, mask)) == 0
    assert one(spark, scores.masked_rate(F.array(*[F.lit(1.0)] * 24), mask)) is None


def test_daylight_saving(spark):
    days = spark.createDataFrame([(T(2021, 7, 1, 12),), (T(2021, 10, 31, 2, 30),)], "t timestamp_ntz").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in days.select(local_to_utc(F.col("t"), "Europe/Paris")).collect()] == [T(2021, 7, 1, 10), None]
    with pytest.raises(Exception, match="no such local time"):
        spark.range(1).select(local_to_utc(F.lit("2021-03-28 02:30:00").cast("timestamp"), "Europe/Paris")).collect()


def test_parsed_time(spark):
    df = spark.createDataFrame([("07:05",), ("7:05",), ("07:05:30",), ("  ",), ("noon",), (None,)], "t string")
    assert [r[0] for r in df.select(parsed_time(F.lit("2020-01-02").cast("date"), F.col("t"))).collect()] == [T(2020, 1, 2, 7, 5), T(2020, 1, 2, 7, 5), T(2020, 1, 2, 7, 5, 30), None, None, None]


@pytest.mark.parametrize("score, ref, lower, expected", [(1.0, 2.0, True, 0.5), (1.0, 0.0, True, None), (0.5, 0.2, False, 0.375), (0.5, 1.0, False, None), (float("nan"), 1.0, True, None)])
def test_skill(spark, score, ref, lower, expected):
    assert one(spark, scores.skill(F.lit(score), F.lit(ref), lower)) == (pytest.approx(expected) if expected is not None else None)


def test_events(spark):
    df = spark.createDataFrame([(3.0, 2.0), (1.0, 3.0), (2.0, 0.0), (0.0, 0.0)], "o double, p double")
    c = scores.contingency(F.col("o") >= 2, F.col("p") >= 2)
    assert [df.agg(c[k]).first()[0] for k in ("hits", "misses", "false_alarms", "correct_negatives")] == [1, 1, 1, 1]
    assert df.agg(c["csi"]).first()[0] == pytest.approx(1 / 3)


def test_prior_bias_and_cells(spark):
    shape = [0.0] * 24
    shape[10], shape[11] = 0.6, 0.4
    bias = one(spark, scores.prior_logit_bias(F.array(*map(F.lit, shape))))
    back = [1 / (1 + math.exp(-b)) for b in bias]
    assert back[10] == pytest.approx(0.5, abs=1e-4) and back[11] == pytest.approx(0.5 * 0.4 / 0.6, abs=1e-4) and max(back[:10]) < 1e-4
    assert [one(spark, scores.format_cell(F.lit(x).cast("double"))) for x in (3.0, 0.12345, 12.345, None)] == ["3", "0.123", "12.3", ""]


def _daily(spark, rows):
    return spark.createDataFrame(rows, "species string, year int, doy int, obs double, pred double")


def test_passage(spark):
    got = scoring.passage(_daily(spark, [("a", 1, d, 1.0, 0.0) for d in (1, 2, 3, 4)]), "obs").first()
    assert (got.obs_p10_doy, got.obs_p50_doy, got.obs_p90_doy) == (1, 2, pytest.approx(3.6))
    assert scoring.passage(_daily(spark, [("a", 1, 1, 0.0, 0.0)]), "obs").first().obs_p50_doy is None
    plateau = scoring.passage(_daily(spark, [("a", 1, d, x, 0.0) for d, x in ((1, 1.0), (2, 0.0), (3, 0.0), (4, 1.0))]), "obs").first()
    assert plateau.obs_p50_doy == pytest.approx(np.interp(0.5, [0.5, 0.5, 0.5, 1.0], [1, 2, 3, 4]))


def test_earth_movers(spark):
    hours = [("a", h, o, p) for h, (o, p) in enumerate([(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])]
    got = scoring.day_shapes(spark.createDataFrame(hours, "species string, hour int, obs double, pred double"), ("species",)).first()
    assert got.emd == 1 and got.peak_error == 1


def test_weighted_day_and_persistence(spark):
    d = datetime.date
    rows = [("a", d(2020, 1, 1), 4.0, 0.0, 1.0), ("a", d(2020, 1, 1), 1.0, 0.0, 3.0), ("a", d(2020, 1, 2), 2.0, 0.0, 1.0), ("a", d(2020, 1, 4), 2.0, 0.0, 0.0)]
    got = {r.date.day: r for r in survey.daily_frame(spark.createDataFrame(rows, "species string, date date, obs double, pred double, coverage double")).collect()}
    assert got[1].obs == 1.75 and got[2].persistence == 1.75 and got[4].obs is None and got[4].persistence is None


def test_rate_of_nothing_is_unknown(spark):
    df = spark.createDataFrame([(T(2020, 1, 1, 8), T(2020, 1, 1, 8), 3.0), (T(2020, 1, 1, 8), T(2020, 1, 1, 10), 3.0)], "start timestamp, end timestamp, count double")
    assert [r.rate for r in survey.with_rate(df).collect()] == [None, 1.5]


def test_clamp(spark):
    at = lambda h, m: T(2020, 1, 1, h, m)
    df = spark.createDataFrame([(at(7, 52),), (at(7, 30),), (at(10, 5),), (at(9, 0),), (None,)], "seen timestamp")
    s, e = F.lit(at(8, 0)), F.lit(at(10, 0))
    moved = df.withColumn("seen", survey.clamped_time(F.col("seen"), s, e)).where(survey.inside_period(F.col("seen"), s, e))
    assert [r[0] for r in moved.collect()] == [at(8, 1), at(9, 59), at(9, 0), None]


def test_overlap_over_midnight_and_touching(spark):
    rows = [(1, T(2020, 1, 1, 22), T(2020, 1, 2, 3)), (2, T(2020, 1, 2, 2), T(2020, 1, 2, 4)), (3, T(2020, 1, 2, 4), T(2020, 1, 2, 5)), (4, T(2020, 1, 2, 4), T(2020, 1, 2, 5))]
    df = spark.createDataFrame(rows, "id long, start timestamp, end timestamp")
    assert sorted(r.id for r in intervals.overlapping(df, df, "id", unlike_itself=True).collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in intervals.apart(df.where("id < 4"), df.where("id < 4"), "id", unlike_itself=True).collect()) == [3]
    plan = intervals.overlapping(df, df, "id", unlike_itself=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_hourly_parts(spark):
    df = spark.createDataFrame([(T(2020, 1, 1, 9, 30), T(2020, 1, 1, 11, 0))], "start timestamp, end timestamp")
    assert [(r.part_start.minute, r.part_end.hour) for r in intervals.hourly(df).collect()] == [(30, 10), (0, 11)]
    assert intervals.sample_instants(df).count() == 3


def test_daily_sums_and_means(spark):
    d = datetime.date(2024, 9, 1)
    hours = spark.createDataFrame([("x", d, h, 0.001, 290.0, None) for h in range(24)], "location string, date date, hour int, rain double, warm double, none double")
    got = cube.daily(hours, {"rain": "sum", "warm": "mean", "none": "sum"}).first()
    assert got.rain == pytest.approx(0.024) and got.warm == 290 and got.none == 0


def test_lags_never_cross_gaps(spark):
    dates = [datetime.date(2024, 9, x) for x in (1, 2, 3, 4, 5, 20, 21, 22, 23, 24, 25)]
    days = spark.createDataFrame([("x", d, float(d.day)) for d in dates], "location string, date date, v double")
    lagged = cube.lags(days, 3, ("v",))
    kept = cube.keep_complete(lagged, ("v",), 3)
    assert sorted({r.date.day for r in kept.collect()}) == [3, 4, 5, 22, 23, 24, 25]
    assert all(r.v == r.date.day - r.lag for r in kept.collect())


def test_duplicate_cells_are_refused(spark):
    d = datetime.date(2024, 1, 1)
    with pytest.raises(ValueError):
        cube.checked_unique(spark.createDataFrame([("x", d, 1), ("x", d, 1)], "location string, date date, hour int"))


def test_shape_properties(spark):
    night = night_mask(spark)
    rates = spark.createDataFrame([("a", d, h, m) for d, m in ((200, 10.0), (250, 5.0), (1, 10.0), (300, 0.0)) for h in range(24)], "species string, doy int, hour int, rate double")
    got = climatology.hourly_shape(rates, night).toPandas()
    assert np.allclose(got.groupby("doy")["shape"].sum(), 1)
    assert (got[(got.doy == 1) & (got.hour <= 6)]["shape"] == 0).all()
    assert set(got[got.doy == 300]["shape"].round(6)) == {0.0, round(1 / 12, 6)}


def test_levels_and_days():
    assert climatology.nearest_level(25, registry.QUANTILE_LEVELS) == 20 and climatology.nearest_level(75, registry.QUANTILE_LEVELS) == 70


def test_smoothing_skips_holes(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0)], "species string, doy int, v double")
    assert [r.v for r in climatology.smoothed(df, ("v",), window=3).orderBy("doy").collect()] == [1.0, 2.0, 3.0]


def test_splits():
    split = explore.years_split({"a": list(range(10)), "b": list(range(20, 30))}, seed=1)
    assert sorted(split.values()).count("train") == 14 and list(split.values()).count("val") == 4
    assert split == explore.years_split({"a": list(range(10)), "b": list(range(20, 30))}, seed=1)


def test_weighted_sample_follows_weights(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "id long, w double")
    got = explore.weighted_sample(df, "w", "id", 200, seed=3)
    assert got.count() == 200 and got.where("id % 2 = 0").count() == 0


def test_splines_and_surface():
    x = np.linspace(1, 366, 50)
    assert np.allclose(fitting.spline_basis(x, 1, 366, 8).sum(axis=1), 1)
    doy, hour = np.repeat(np.arange(1, 367, 5), 24).astype(float), np.tile(np.arange(24), 74).astype(float)
    surface = fitting.fit_surface(doy, hour, np.full(len(doy), 2.0), np.ones(len(doy)))
    assert np.allclose(surface, 2, atol=1e-3)


def test_model_search(spark):
    rows = [(d, h, float(1 + (h == 10) * 5 + d % 3)) for d in range(1, 60, 3) for h in range(6, 18)]
    df = spark.createDataFrame(rows, "doy int, hour int, rate double")
    best = fitting.search_tweedie(df, (1.3, 1.6), (1e-3,))
    assert fitting.predict(best, df).where("expected > 0").count() == len(rows)


def test_chunks_and_outstanding(spark):
    plan = cache.chunks(datetime.date(1966, 3, 1), datetime.date(1972, 6, 30), 5)
    assert [(c[2], c[3]) for c in plan] == [(1965, True), (1970, False)] and plan[1][1] == datetime.date(1972, 6, 30)
    table = cache.chunk_table(spark, datetime.date(1966, 3, 1), datetime.date(1972, 6, 30), 5).withColumn("location", F.lit("x"))
    have = spark.createDataFrame([("x", 1965, T(1965, 2, 1)), ("x", 1970, T(1972, 6, 29, 23))], "location string, block_year long, newest timestamp")
    assert [r.block_year for r in cache.outstanding(table, have).collect()] == [1970]
    assert cache.call_weight(14, 10) == 1 and cache.pace_seconds(5000) == 3600


def test_cache_round_trip_and_pushdown(spark, tmp_path):
    hours = spark.createDataFrame([(x, T(2020, 7, d, h), float(h)) for x in ("a", "b") for d in (1, 2) for h in (0, 12)], "location string, datetime timestamp, v double")
    to = str(tmp_path / "c")
    cache.write(hours, to)
    got = cache.load(spark, to, ["a"], ["v"], years=[2020], doy=(183, 183))
    assert got.count() == 2 and got.columns == ["location", "datetime", "year", "doy", "v"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "location" in plan.split("PartitionFilters: ")[1][:80] and "GreaterThanOrEqual(doy" in plan
    with pytest.raises(ValueError):
        cache.load(spark, to, ["nowhere"], ["v"])
    with pytest.warns(UserWarning):
        cache.load(spark, to, ["a"], ["v"], years=[2020, 1999])
    assert cache.newest_hours(cache.with_keys(hours), 5).where("block_year = 2020").count() == 2


def test_weather_from_stored_answers(spark, tmp_path):
    n = 24 * 5
    for place in ("Gorge", "Basel"):
        hourly = {"start": 1717200000, "end": 1717200000 + 3600 * n, "interval": 3600, "temperature_2m": [float(i % 24) for i in range(n)], "precipitation": [1.0] * n}
        (tmp_path / f"{place}.json").write_text(json.dumps({"hourly": hourly}))
    args = {"source": "archive", "start": "2024-06-01", "end": "2024-06-05", "responses": str(tmp_path)}
    hours = forecasts.weather(spark, ["Gorge", "Basel"], ["temperature_2m", "total_precipitation", "sun_altitude"], **args)
    assert hours.count() == 2 * n and hours.agg(F.min("temperature_2m")).first()[0] == pytest.approx(273.15) and "sun_azimuth" in hours.columns
    days = forecasts.weather(spark, ["Gorge", "Basel"], ["temperature_2m", "total_precipitation"], resolution="daily", lag_days=2, **args)
    assert days.count() == 4 * 2 * 2 and days.agg(F.max("total_precipitation")).first()[0] == pytest.approx(0.024)
    for bad in ({"source": "crystal ball"}, {"resolution": "yearly"}, {"source": "cache"}, {"source": "archive"}, {"source": "forecast", "resolution": "daily"}):
        with pytest.raises(ValueError):
            forecasts.weather(spark, "Gorge", "temperature_2m", **bad)


def test_retries():
    import urllib.error

    calls, waits = [], []

    def get(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(url, 429 if len(calls) == 1 else 503, "later", {}, None)
        return b'{"ok": 1}'

    assert forecasts.fetched("u", 1, wait=waits.append, get=get) == {"ok": 1} and waits == [90, 0.4]
    with pytest.raises(urllib.error.HTTPError):
        forecasts.fetched("u", 1, wait=waits.append, get=lambda u, t: (_ for _ in ()).throw(urllib.error.HTTPError(u, 404, "no", {}, None)))


def test_files(spark, tmp_path):
    path = str(tmp_path / "x.json")
    assert records.write_json(spark.range(3), path) == 3 and [r["id"] for r in json.load(open(path))] == [0, 1, 2]
    records.write_run(str(tmp_path / "r1.json"), "Osprey", {"mae": 1.0, "bias": 2.0}, [], [])
    records.write_run(str(tmp_path / "r2.json"), "Osprey", {"mae": 3.0}, [], [])
    runs = records.runs(spark, [str(tmp_path / "r*.json"), str(tmp_path / "none*.json")])
    got = {r.metric: r for r in scoring.seed_summary(runs).collect()}
    assert got["mae"].mean == 2 and got["bias"].std is None and got["mae"].provisional
    assert records.latest_run(["logs/2024-01-02_03-04-05", "logs/2024-01-02_03-04-06", "logs/other"]) == "logs/2024-01-02_03-04-06"
    (tmp_path / "a.yaml").write_text('data:\n  species: "Red Kite"\n')
    assert records.species_of_experiments(str(tmp_path)) == ["Red Kite"]
    source = tmp_path / "model"
    source.mkdir()
    to = str(tmp_path / "prod")
    assert [records.promote({"Red Kite": str(source)}, to, dry_run=d)["Red Kite"] for d in (True, False, False)] == ["would copy", "copied", "kept"]
    counts = spark.createDataFrame([("a", datetime.date(2020, 1, 1), 2.0, T(2020, 1, 1, 8), T(2020, 1, 1, 9))], records.COUNTS)
    records.write_counts(counts, str(tmp_path / "counts"))
    assert records.counts(spark, str(tmp_path / "counts")).collect() == counts.collect()


def test_taxonomy_must_be_unique(spark):
    tax = spark.createDataFrame([("a", "A"), ("a", "B")], "species string, name string")
    with pytest.raises(ValueError):
        survey.with_taxonomy(tax.select("species"), tax)


def test_stream(spark, tmp_path):
    from tallywing.streaming import rollup

    hours = spark.createDataFrame([("x", T(2020, 1, d, h), 1.0) for d in (1, 2, 9) for h in range(24)], "location string, datetime timestamp, v double")
    hours.coalesce(1).write.parquet(str(tmp_path / "in"))
    days = rollup.daily(rollup.files(spark, str(tmp_path / "in"), "location string, datetime timestamp, v double"), {"v": "sum"})
    rollup.run_once(days, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.date.day: r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: 24.0, 2: 24.0}
