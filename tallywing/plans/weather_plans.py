"""Queries on station hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.weather import sun_position, wind_components
from ..operators import cube
from ..registry import LOCATIONS
from ..sources import cache
from . import adapters as a
from . import query

_KEY = "location, date::VARCHAR AS date"


@query(f"WITH {a.STATION} SELECT {_KEY}, hour::BIGINT AS hour, round(v1 + 273.15, 6) AS kelvin, round(v1 * 100, 4) AS pascal, round(v2 / 1000, 6) AS metres, round(v1 / 100, 6) AS fraction, round(v2 * 3600, 2) AS joules FROM wx")
def wx_units(spark, sf_dir):
    from ..registry import VARIABLES as V

    w = a.station_hours(spark, sf_dir)
    c = lambda name, x: V[name].convert(F.col(x))
    out = w.select(
        "location", "date", "hour", F.round(c("temperature_2m", "v1"), 6).alias("kelvin"), F.round(c("surface_pressure", "v1"), 4).alias("pascal"),
        F.round(c("total_precipitation", "v2"), 6).alias("metres"), F.round(c("total_cloud_cover", "v1"), 6).alias("fraction"), F.round(c("surface_solar_radiation_downwards", "v2"), 2).alias("joules"),
    )
    return a.written(out)


@query(f"WITH {a.STATION} SELECT {_KEY}, hour::BIGINT AS hour, round(-v1 * sin(radians(dir)), 6) AS u, round(-v1 * cos(radians(dir)), 6) AS v FROM wx")
def wx_wind(spark, sf_dir):
    u, v = wind_components(F.col("v1"), F.col("dir"))
    return a.written(a.rounded(a.station_hours(spark, sf_dir).select("location", "date", "hour", (u + 0.0).alias("u"), (v + 0.0).alias("v")), "u", "v"))


def _sun_sql(epoch: str, lat: float, lon: float) -> str:
    return f"""s0 AS (SELECT *, {epoch} / 86400.0::DOUBLE - 0.5 + 2440588.0 - 2451545.0 AS d FROM base),
s1 AS (SELECT *, radians(357.5291 + 0.98560028 * d) AS m FROM s0),
s2 AS (SELECT *, m + radians(1.9148 * sin(m) + 0.02 * sin(2 * m) + 0.0003 * sin(3 * m)) + radians(102.9372) + pi() AS l FROM s1),
s3 AS (SELECT *, asin(sin(radians(23.4397)) * sin(l)) AS dec, radians(280.16 + 360.9856235 * d) + radians({lon}) - atan2(sin(l) * cos(radians(23.4397)), cos(l)) AS h FROM s2),
sun AS (SELECT *, asin(sin(radians({lat})) * sin(dec) + cos(radians({lat})) * cos(dec) * cos(h)) AS altitude, atan2(sin(h), cos(h) * sin(radians({lat})) - tan(dec) * cos(radians({lat}))) AS azimuth FROM s3)"""


_LAT, _LON = LOCATIONS["Gorge"]


@query(f"WITH {a.STATION}, base AS (SELECT *, epoch(date + to_hours(hour))::DOUBLE AS t FROM wx), {_sun_sql('t', _LAT, _LON)} SELECT {_KEY}, hour::BIGINT AS hour, round(altitude, 5) AS altitude, round(azimuth, 5) AS azimuth FROM sun")
def wx_sun(spark, sf_dir):
    w = a.station_hours(spark, sf_dir)
    altitude, azimuth = sun_position(F.unix_seconds(F.col("date").cast("timestamp")) + F.col("hour") * 3600.0, _LAT, _LON)
    return a.written(a.rounded(w.select("location", "date", "hour", altitude.alias("altitude"), azimuth.alias("azimuth")), "altitude", "azimuth", digits=5))


def night_mask(spark, threshold: float = -6.0, station: str = "Gorge", year: int = 2001):
    """doy, hour and night: whether the sun is lower than the threshold at that hour (UTC) of that day."""
    lat, lon = LOCATIONS[station]
    grid = spark.range(1, 367).select(F.col("id").cast("int").alias("doy"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    start = F.unix_seconds(F.lit(f"{year}-01-01").cast("timestamp"))
    altitude, _ = sun_position(start + (F.col("doy") - 1) * 86400.0 + F.col("hour") * 3600.0, lat, lon)
    return grid.select("doy", "hour", (F.degrees(altitude) < threshold).alias("night"))


@query(f"WITH base AS (SELECT doy, hour, epoch(DATE '2001-01-01')::DOUBLE + (doy - 1) * 86400.0 + hour * 3600.0 AS t FROM range(1, 367) r(doy) CROSS JOIN range(24) q(hour)), {_sun_sql('t', _LAT, _LON)} SELECT doy::BIGINT AS doy, hour::BIGINT AS hour, degrees(altitude) < -6 AS night FROM sun")
def wx_night_mask(spark, sf_dir):
    return a.written(night_mask(spark))


@query(f"WITH {a.DENSE} SELECT {_KEY}, hour::BIGINT AS hour, round(v1, 6) AS v1, round(v2, 4) AS v2 FROM cube")
def wx_densify(spark, sf_dir):
    dense = cube.dense(cube.checked_unique(a.station_hours(spark, sf_dir)))
    return a.written(dense.select("location", "date", "hour", F.round("v1", 6).alias("v1"), F.round("v2", 4).alias("v2")))


_DAILY = f"WITH {a.DENSE}, days AS (SELECT location, date, avg(v1) AS v1, coalesce(sum(v2), 0) AS v2 FROM cube GROUP BY ALL)"


def days(spark, sf_dir):
    return cube.daily(cube.dense(a.station_hours(spark, sf_dir)), {"v1": "mean", "v2": "sum"})


@query(f"{_DAILY} SELECT {_KEY}, round(v1, 6) AS v1, round(v2, 4) AS v2 FROM days")
def wx_daily(spark, sf_dir):
    return a.written(days(spark, sf_dir).select("location", "date", F.round("v1", 6).alias("v1"), F.round("v2", 4).alias("v2")))


_LAGS = f"{_DAILY}, part AS (SELECT * FROM days WHERE day(date) % 10 <> 7), lg AS (SELECT p.location, p.date, k.lag, q.v1, q.v2 FROM part p CROSS JOIN (SELECT unnest(range(4)) AS lag) k LEFT JOIN part q ON q.location = p.location AND q.date = p.date - k.lag::INT)"


def lagged(spark, sf_dir):
    return cube.lags(days(spark, sf_dir).where(F.dayofmonth("date") % 10 != 7), 4, ("v1", "v2"))


@query(f"{_LAGS} SELECT {_KEY}, lag::BIGINT AS lag, round(v1, 6) AS v1, round(v2, 4) AS v2 FROM lg")
def wx_lags(spark, sf_dir):
    return a.written(lagged(spark, sf_dir).select("location", "date", "lag", F.round("v1", 6).alias("v1"), F.round("v2", 4).alias("v2")))


@query(f"{_LAGS} SELECT date::VARCHAR AS date FROM lg GROUP BY date HAVING count(*) FILTER (WHERE v1 IS NOT NULL AND v2 IS NOT NULL) = 4 * (SELECT count(DISTINCT location) FROM events_l)".replace("events_l", "(SELECT event_type AS location FROM events)"))
def wx_complete_dates(spark, sf_dir):
    wide = lagged(spark, sf_dir)
    n = a.table(spark, sf_dir, "events").select("event_type").distinct().count()
    return a.written(cube.complete_dates(wide, ("v1", "v2"), 4 * n))


_PARAMS = f"WITH {a.STATION}, par AS (SELECT avg(v1) AS m1, stddev_pop(v1) AS s1, avg(ln(greatest(v2, 1e-9))) AS m2, stddev_pop(ln(greatest(v2, 1e-9))) AS s2, min(dir) AS lo, max(dir) AS hi FROM wx)"
_KINDS = {"v1": "standardize", "v2": "log_standardize", "dir": "minmax"}


@query(f"{_PARAMS} SELECT 'v1' AS variable, 'standardize' AS kind, round(m1, 5) AS p1, round(s1, 5) AS p2 FROM par UNION ALL SELECT 'v2', 'log_standardize', round(m2, 5), round(s2, 5) FROM par UNION ALL SELECT 'dir', 'minmax', round(lo, 5), round(hi, 5) FROM par")
def wx_transform_fit(spark, sf_dir):
    return a.rounded(cube.fit_transforms(a.station_hours(spark, sf_dir), _KINDS), "p1", "p2", digits=5)


@query(f"{_PARAMS} SELECT {_KEY}, hour::BIGINT AS hour, round((v1 - m1) / s1, 5) AS v1, round((ln(greatest(v2, 1e-9)) - m2) / s2, 5) AS v2, round((dir - lo) / (hi - lo), 5) AS dir FROM wx, par")
def wx_normalise(spark, sf_dir):
    w = a.station_hours(spark, sf_dir)
    out = cube.apply_transforms(w, cube.fit_transforms(w, _KINDS), ("v1", "v2", "dir"))
    return a.written(a.rounded(out.select("location", "date", "hour", "v1", "v2", "dir"), "v1", "v2", "dir", digits=5))


@query(f"""WITH {a.STATION}, p AS (SELECT date, 'v1' AS variable, v1 AS l, v1 * 1.1 + 0.5 AS r FROM wx UNION ALL SELECT date, 'v2', v2, v2 - v1 FROM wx)
SELECT variable, count(DISTINCT date)::BIGINT AS n_dates, round(avg(r - l), 4) AS bias, round(stddev_pop(r) / stddev_pop(l), 5) AS std_ratio, round(corr(l, r), 5) AS corr FROM p GROUP BY variable""")
def parity_stats(spark, sf_dir):
    left = a.station_hours(spark, sf_dir)
    right = left.select("location", "date", "hour", (F.col("v1") * 1.1 + 0.5).alias("v1"), (F.col("v2") - F.col("v1")).alias("v2"))
    out = cube.parity(left, right, ("location", "date", "hour"), ("v1", "v2"))
    return a.written(out.select("variable", "n_dates", F.round("bias", 4).alias("bias"), F.round("std_ratio", 5).alias("std_ratio"), F.round("corr", 5).alias("corr")))


@query(f"WITH {a.STATION} SELECT {_KEY}, hour::BIGINT AS hour, round(v1, 6) AS v1 FROM wx WHERE location IN ('click', 'view') AND dayofyear(date) BETWEEN 5 AND 20")
def cache_pruned_scan(spark, sf_dir):
    """The stations' hours written as a cache by location, and read with filters that reach its files."""
    to = cache.shared_folder(spark, "station-cache")
    hours = a.station_hours(spark, sf_dir)
    cache.write(hours.withColumn("datetime", F.col("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("hour"))).drop("date", "hour"), to)
    found = cache.load(spark, to, ["click", "view"], ["v1"], doy=(5, 20), strict=False)
    return a.written(found.select("location", F.to_date("datetime").alias("date"), F.hour("datetime").alias("hour"), F.round("v1", 6).alias("v1")))


@query(f"WITH {a.STATION} SELECT location, count(*)::BIGINT AS n, count(*) FILTER (WHERE v1 IS NULL)::BIGINT AS missing_v1 FROM wx GROUP BY location")
def cache_missing_values(spark, sf_dir):
    w = a.station_hours(spark, sf_dir)
    return w.groupBy("location").agg(F.count("*").alias("n"), F.count_if(F.col("v1").isNull()).alias("missing_v1"))


@query("""SELECT y AS block_year, (greatest(DATE '1996-01-01', make_date(y, 1, 1)))::VARCHAR AS lo, least(make_date(y + 4, 12, 31), DATE '2001-11-04')::VARCHAR AS hi, make_date(y + 4, 12, 31) <= DATE '2001-11-04' AS complete
FROM (SELECT unnest(range(1995, 2002, 5))::BIGINT AS y)""".replace("greatest(DATE '1996-01-01', make_date(y, 1, 1))", "make_date(y, 1, 1)"))
def chunk_plan(spark, sf_dir):
    import datetime

    return cache.chunk_table(spark, datetime.date(1996, 1, 1), datetime.date(2001, 11, 4), 5)


@query("SELECT (DATE '2020-07-20' + i::INT)::VARCHAR AS date, dayofyear(DATE '2020-07-20' + i::INT)::BIGINT AS doy, 2200::BIGINT AS year_used FROM range(6) r(i)")
def forecast_dates(spark, sf_dir):
    from ..functions.time import year_used
    from ..registry import ERA_EDGES, PERIOD_YEARS

    days = spark.range(1).select(F.explode(F.sequence(F.lit("2020-07-20").cast("date"), F.date_add(F.lit("2020-07-20").cast("date"), 5))).alias("date"))
    return a.written(days.select("date", F.dayofyear("date").alias("doy"), year_used(F.year("date"), "period", ERA_EDGES, PERIOD_YEARS).alias("year_used")))


@query(f"""{_LAGS}, sp AS (SELECT DISTINCT location FROM wx), ok AS (SELECT date FROM lg GROUP BY date HAVING count(*) FILTER (WHERE v1 IS NOT NULL AND v2 IS NOT NULL) = 4 * (SELECT count(*) FROM sp)),
f AS (SELECT date, count(*) AS n, sum(v1) AS total FROM lg WHERE date IN (SELECT date FROM ok) GROUP BY date)
SELECT date::VARCHAR AS date, (2 * n)::BIGINT AS n_features, round(total, 4) AS total_v1 FROM f""")
def model_feature_rows(spark, sf_dir):
    """One row a complete date with all its stations' and lags' values as one array, in a fixed order."""
    n = a.table(spark, sf_dir, "events").select("event_type").distinct().count()
    wide = cube.keep_complete(lagged(spark, sf_dir), ("v1", "v2"), 4 * n)
    rows = wide.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("location", "lag", "v1", "v2"))).alias("cells"))
    rows = rows.select("date", F.flatten(F.transform("cells", lambda c: F.array(c["v1"], c["v2"]))).alias("features"))
    total = F.aggregate(F.filter("features", lambda x, i: i % 2 == 0), F.lit(0.0), lambda s, x: s + x)
    return a.written(rows.select("date", F.size("features").alias("n_features"), F.round(total, 4).alias("total_v1")))


@query(f"WITH {a.STATION} SELECT DISTINCT location FROM (VALUES ('click'), ('nowhere'), ('view')) t(location) WHERE location NOT IN (SELECT location FROM wx)")
def requested_minus_present(spark, sf_dir):
    asked = spark.createDataFrame([("click",), ("nowhere",), ("view",)], "location string")
    return asked.subtract(a.station_hours(spark, sf_dir).select("location"))
