"""Queries whose rows go through a file format and back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import parsed_time
from ..sources import cache, files, forecasts, records, workbooks
from . import adapters as a
from . import query
from .adapters import intervals

#: Ids that one sheet covers: a sheet of the format has a million rows at most.
IDS_A_SHEET = 100_000
_STYLES = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="21"/></cellXfs></styleSheet>'
_DAY = pd.Timestamp("1899-12-30")


def _cell(value, style: int) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, str):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f'<c s="{style}"><v>{value!r}</v></c>'


def workbook_of(rows: pd.DataFrame, sheet: str, dates: tuple[str, ...] = (), times: tuple[str, ...] = ()) -> bytes:
    """A workbook of one sheet; dates are days, times minutes of the day."""
    columns = {c: (rows[c] - _DAY).dt.days if c in dates else rows[c] / 1440 if c in times else rows[c] for c in rows}
    styles = [1 if c in dates else 2 if c in times else 0 for c in columns]
    lines = ["".join(_cell(c, 0) for c in columns)] + ["".join(map(_cell, r, styles)) for r in zip(*(v.tolist() for v in columns.values()), strict=True)]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{relations}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="{relations}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{x}</row>" for x in lines)}</sheetData></worksheet>')
    return out.getvalue()


def _as_workbooks(rows: DataFrame) -> DataFrame:
    """path and content: a workbook for each year and run of ids."""

    def book(group: pd.DataFrame) -> pd.DataFrame:
        path = f"counts_{group['part'].iloc[0]}_{group['year'].iloc[0]}.xlsx"
        return pd.DataFrame({"path": [path], "content": [workbook_of(group.drop(columns=["year", "part"]), "counts", ("date",), ("startTime", "endTime"))]})

    keyed = rows.withColumn("year", F.year("date")).withColumn("part", F.floor(F.col("id") / IDS_A_SHEET)).withColumn("date", F.col("date").cast("timestamp_ntz"))
    return keyed.groupBy("year", "part").applyInPandas(book, "path string, content binary")


@query("""
SELECT o_orderkey AS id, o_orderpriority AS species, o_orderdate::DATE AS date, (o_custkey % 5)::DOUBLE AS count,
  o_orderdate::DATE::TIMESTAMP + to_minutes((240 + 60 * (o_orderkey % 12) + 15 * (o_custkey % 4))::INT) AS start,
  CASE WHEN o_custkey % 3 > 0 THEN o_orderdate::DATE::TIMESTAMP + to_minutes((240 + 60 * (o_orderkey % 12) + 15 * (o_custkey % 4) + 15 * (1 + o_orderkey % 29))::INT) END AS end
FROM orders""")
def workbook_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that went into yearly workbooks as days and times of day, a third without an end, and come back as rows."""
    minutes = lambda c: (F.hour(c) * 60 + F.minute(c)).cast("double")
    rows = intervals(spark, sf_dir, ends=F.col("o_custkey") % 3 > 0)
    written = rows.select("id", "species", "date", "count", minutes("start").alias("startTime"), F.when(F.col("ends"), minutes("end")).alias("endTime"))
    found = workbooks.parse(_as_workbooks(written), "counts", "id long, species string, date timestamp, count double, startTime string, endTime string")
    day = F.to_date("date")
    return found.select("id", "species", day.alias("date"), "count", parsed_time(day, F.col("startTime")).alias("start"), parsed_time(day, F.col("endTime")).alias("end"))


@query("""SELECT o_orderpriority AS species, o_orderdate::DATE::VARCHAR AS date, (o_custkey % 5)::DOUBLE AS count,
  (o_orderdate::DATE::TIMESTAMP + to_minutes((240 + 60 * (o_orderkey % 12) + 15 * (o_custkey % 4))::INT))::VARCHAR AS start,
  (o_orderdate::DATE::TIMESTAMP + to_minutes((240 + 60 * (o_orderkey % 12) + 15 * (o_custkey % 4) + 15 * (1 + o_orderkey % 29))::INT))::VARCHAR AS end FROM orders""")
def count_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count records through files of delimited text and back under their schema."""
    to = cache.shared_folder(spark, "counts")
    records.write_counts(intervals(spark, sf_dir), to)
    found = records.counts(spark, to)
    return found.select("species", F.col("date").cast("string").alias("date"), "count", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")])


@query("""SELECT s_name AS species, n_name AS "English name", CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey::INT END AS trektellen_species_id FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def taxonomy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy through delimited text and back; where its id is no number it is null."""
    s, n = a.table(spark, sf_dir, "supplier"), a.table(spark, sf_dir, "nation")
    ids = F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey").cast("string")).otherwise(F.concat(F.lit("n/a "), F.col("s_suppkey")))
    to = cache.shared_folder(spark, "taxonomy")
    s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("species"), F.col("n_name").alias("English name"), ids.alias("trektellen_species_id")).write.csv(to, header=True)
    return records.taxonomy(spark, to)


@query("SELECT l_orderkey AS countid, o_orderdate::DATE::VARCHAR AS date, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS birds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def body_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted birds with the surveys that they belong to, by survey."""
    body = a.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("countid"), F.col("l_quantity").alias("direction1"))
    header = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("date"))
    return records.body_with_header(body, header).groupBy("countid", "date").agg(F.count("*").alias("n"), F.sum("direction1").alias("birds"))


@query(f"WITH {a.HOURS}, st AS (SELECT species, doy, min(rate) AS least, max(rate) AS most, avg(rate) AS mean FROM dy GROUP BY ALL) SELECT species::VARCHAR AS species, doy::BIGINT AS doy, round(least, 6) AS min, round(most, 6) AS max, round(mean, 6) AS mean FROM st")
def climatology_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A climatology as one record a species in a file of its own format, read back and laid out by day."""
    stats = a.daily(spark, sf_dir).groupBy("species", "doy").agg(F.min("rate").alias("min"), F.max("rate").alias("max"), F.avg("rate").alias("mean"))
    days = stats.groupBy(F.col("species").cast("string").alias("species")).agg(F.array_sort(F.collect_list(F.struct("doy", "min", "max", "mean"))).alias("d"))
    to = f"{cache.shared_folder(spark, 'climatology')}.json"
    records.write_json(days.select("species", *[F.col(f"d.{c}").alias(c) for c in ("doy", "min", "max", "mean")]), to)
    found = records.climatology(spark, to).select("species", F.inline(F.arrays_zip("doy", "min", "max", "mean")))
    return a.written(a.rounded(found.withColumn("doy", F.col("doy").cast("long")), "min", "max", "mean"))


@query(f"WITH {a.HOURS}, m AS (SELECT species, year, avg(rate) AS rate, sum(count) AS birds FROM dy GROUP BY ALL) SELECT species::VARCHAR AS species, year::BIGINT AS year, 'rate' AS metric, round(rate, 6) AS value FROM m UNION ALL SELECT species::VARCHAR, year::BIGINT, 'birds', round(birds, 6) FROM m")
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of runs, a file a run, found by pattern and read as one table."""
    runs = a.daily(spark, sf_dir).groupBy("species", "year").agg(F.avg("rate").alias("rate"), F.sum("count").alias("birds"))
    folder = cache.shared_folder(spark, "runs")
    for r in runs.collect():  # a row a species and year: runs are few
        records.write_run(f"{folder}/run-{r['species']}-{r['year']}.json", str(r["species"]), {"rate": r["rate"], "birds": r["birds"]}, [], [])
    found = records.runs(spark, [f"{folder}/run-*.json", f"{folder}/none-*.json"])
    return a.rounded(found.select("species", F.regexp_extract("run", r"-(\d+)\.json$", 1).cast("long").alias("year"), "metric", "value"), "value")


_PLACES = ["Basel", "Munich", "Dijon", "Berlin", "Prague"]


@query(f"""WITH e AS (SELECT event_type, date_trunc('hour', ts) AS h, avg(value) AS t, sum(value) AS p FROM events GROUP BY ALL), l AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events)),
g AS (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS h FROM events)
SELECT list_extract({_PLACES}, k::INT) AS location, g.h::VARCHAR AS datetime, round(t + 273.15, 6) AS temperature_2m, round(p / 1000, 8) AS total_precipitation FROM l CROSS JOIN g LEFT JOIN e ON e.event_type = l.event_type AND e.h = g.h WHERE k <= {len(_PLACES)}""")
def archive_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of five places through stored answers of the archive: gaps stay null, units are converted."""
    e = a.table(spark, sf_dir, "events").select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "value")
    hours = e.groupBy("event_type", "h").agg(F.avg("value").alias("t"), F.sum("value").alias("p"))
    first, last = e.agg(F.min(F.to_date("h")), F.max(F.to_date("h"))).first()
    day = lambda d: F.unix_seconds(F.lit(d).cast("timestamp"))
    span = F.sequence(day(first), day(last) + 23 * 3600, F.lit(3600).cast("long"))
    at = lambda v: F.map_from_entries(F.collect_list(F.struct(F.unix_seconds("h"), F.col(v))))
    own = hours.groupBy("event_type").agg(at("t").alias("t"), at("p").alias("p"))
    series = lambda v: F.transform(span, lambda x: F.try_element_at(F.col(v), x))
    hourly = F.struct(day(first).alias("start"), (day(last) + 24 * 3600).alias("end"), F.lit(3600).alias("interval"), series("t").alias("temperature_2m"), series("p").alias("precipitation"))
    folder = cache.shared_folder(spark, "answers")
    answers = own.orderBy("event_type").limit(len(_PLACES)).select(F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias("j")).collect()  # an answer a place
    for place, r in zip(_PLACES, answers, strict=False):
        files.put(spark, f"{folder}/{place}.json", [r["j"]])
    found = forecasts.archive(spark, _PLACES[: len(answers)], ["temperature_2m", "total_precipitation"], str(first), str(last), responses=folder)
    out = found.select("location", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "temperature_2m", "total_precipitation")
    return a.rounded(a.rounded(out, "temperature_2m"), "total_precipitation", digits=8)


@query(f"WITH {a.HOURS} SELECT species, run_date, date, hour, rate FROM (SELECT 'species_' || species AS species, '2026-07-14' AS run_date, date::VARCHAR AS date, hour::BIGINT AS hour, round(rate, 6) AS rate FROM hs)")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every species in files of a species and run date; writing one again replaces its own alone."""
    to, hs = cache.shared_folder(spark, "predictions"), a.hour_surveys(spark, sf_dir)
    for r in hs.select("species").distinct().collect():
        rows = hs.where(F.col("species") == r["species"]).select("date", "hour", "rate")
        for _ in range(2 if r["species"] == 3 else 1):
            records.write_predictions(rows, to, "2026-07-14", f"species {r['species']}")
    found = spark.read.option("partitionOverwriteMode", "dynamic").parquet(to)
    return a.written(a.rounded(found.select("species", F.col("run_date").cast("string").alias("run_date"), "date", "hour", "rate"), "rate"))


@query(f"WITH {a.STATION} SELECT location, (date + to_hours(hour::INT))::VARCHAR AS datetime, year(date)::BIGINT AS year, dayofyear(date)::BIGINT AS doy, round(v2, 6) AS v2 FROM wx WHERE dayofyear(date) BETWEEN 3 AND 25 AND year(date) = (SELECT max(year(date)) FROM wx)")
def cache_of_a_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stations' hours of the last year and of a season with the days before it that its lags need."""
    hours = a.station_hours(spark, sf_dir)
    to = cache.shared_folder(spark, "season-cache")
    cache.write(hours.withColumn("datetime", F.col("date").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("hour"))).drop("date", "hour"), to)
    places = [r[0] for r in hours.select("location").distinct().collect()]  # stations are few
    last = hours.agg(F.max(F.year("date"))).first()[0]
    found = cache.load(spark, to, places, ["v2"], [last], cache.widened_doy((10, 25), 7))
    return a.written(a.rounded(found.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")), "v2"))


@query(f"WITH {a.HOURS}, {a.STATION.strip()}, dw AS (SELECT make_date(1996 + (row_number() OVER (ORDER BY date) % 5)::INT, month(date), day(date)) AS date, avg(v1) AS v1 FROM wx WHERE NOT (month(date) = 2 AND day(date) = 29) GROUP BY wx.date) SELECT species::BIGINT AS species, dy.date::VARCHAR AS date, round(rate, 6) AS rate, round(v1, 6) AS v1 FROM dy JOIN dw ON dy.date = dw.date")
def days_beside_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rates of the dates that have weather, beside it; the stations' days are set into the years of the surveys."""
    from ..operators import explore

    w = a.station_hours(spark, sf_dir).groupBy("date").agg(F.avg("v1").alias("v1")).where("NOT (month(date) = 2 AND day(date) = 29)")
    placed = w.withColumn("n", F.row_number().over(W.orderBy("date"))).select(F.make_date((1996 + F.col("n") % 5).cast("int"), F.month("date"), F.dayofmonth("date")).alias("date"), "v1")  # 30 days
    return a.written(a.rounded(explore.with_weather(a.daily(spark, sf_dir).select("species", "date", "rate"), placed), "rate", "v1"))
