"""Surveys of uneven length from end to end: cleaning, backfill, sample assembly and verification in one call."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import trial_features, z_score
from ..functions.time import clock_hours, coverage_mask
from ..operators import climatology, cube, explore, intervals, scoring, survey
from ..sources import cache
from . import adapters as a
from . import query
from .climatology_plans import _SHAPE, shapes
from .explore_plans import _YEARS, years

EDGES, LABELS = (1996, 1997), ("early", "middle", "late")


def surveys(spark, sf_dir):
    """Surveys of a quarter of an hour to an hour and a half, some of five hours, that share hours and days."""
    o = a.table(spark, sf_dir, "orders")
    minutes = lambda m: F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"), F.lit(0))
    date = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("o_custkey") % 1000).cast("int"))
    first = 240 + 15 * (F.col("o_orderkey") % 50)
    long = F.when(F.col("o_orderkey") % 97 == 0, F.lit(300)).otherwise(15 * (1 + F.col("o_orderkey") % 6))
    rows = o.select((F.col("o_orderkey") % 2).cast("int").alias("species"), F.col("o_orderkey").alias("row"), date.alias("date"), first.alias("s"), (first + long).alias("e"), (F.col("o_custkey") % 23).cast("double").alias("obs"))
    day = F.col("date").cast("timestamp")
    rows = rows.withColumns({"start": day + minutes(F.col("s")), "end": day + minutes(F.col("e"))})
    return rows.withColumn("mask", coverage_mask(clock_hours(F.col("start")), clock_hours(F.col("end")), exact=True))


def frame(spark, sf_dir):
    """The surveys beside predictions by hour and a climatology of their own."""
    rows = surveys(spark, sf_dir)
    hourly = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.log1p((3 + F.dayofyear("date") % 7) * (1 + (h % 5) / F.lit(4.0))))
    told = rows.select("species", "row", hourly.alias("pred_hourly"))
    clim = rows.groupBy("species", F.dayofyear("date").alias("doy")).agg(F.avg("obs").alias("phen"))
    return scoring.build_frame(rows, told, clim, EDGES, LABELS)


_DAY = "DATE '1995-01-01' + (o_custkey % 1000)::INT"
SURVEYS = f"""
rs AS (SELECT (o_orderkey % 2)::INT AS species, o_orderkey AS row, ({_DAY})::DATE AS date, (240 + 15 * (o_orderkey % 50))::BIGINT AS s, (o_custkey % 23)::DOUBLE AS obs,
       (240 + 15 * (o_orderkey % 50) + CASE WHEN o_orderkey % 97 = 0 THEN 300 ELSE 15 * (1 + o_orderkey % 6) END)::BIGINT AS e FROM orders),
wh AS (SELECT rs.*, h, dayofyear(date) AS doy, year(date) AS year, CASE WHEN year(date) < 1996 THEN 'early' WHEN year(date) < 1997 THEN 'middle' ELSE 'late' END AS era,
       (least(e, 60 * (h + 1)) - greatest(s, 60 * h)) / 60.0::DOUBLE AS mask, (3 + dayofyear(date) % 7) * (1 + (h % 5) / 4.0::DOUBLE) AS pred_hour FROM rs CROSS JOIN range(24) r(h) WHERE least(e, 60 * (h + 1)) > greatest(s, 60 * h))"""
FRAME = (
    SURVEYS
    + """,
cl AS (SELECT species, dayofyear(date) AS doy, avg(obs) AS phen FROM rs GROUP BY ALL),
ev AS (SELECT w.*, phen FROM (SELECT species, row, date, doy, year, era, any_value(obs) AS obs, sum(mask * pred_hour) / sum(mask) AS pred, sum(mask) AS coverage, min(h) AS start_hour FROM wh GROUP BY ALL) w JOIN cl USING (species, doy)),
df0 AS (SELECT species, date, any_value(doy) AS doy, any_value(year) AS year, any_value(era) AS era, any_value(phen) AS phen, sum(obs * coverage) / sum(coverage) AS obs, sum(pred * coverage) / sum(coverage) AS pred FROM ev GROUP BY species, date),
df AS (SELECT a.*, b.obs AS persistence FROM df0 a LEFT JOIN df0 b ON a.species = b.species AND b.date = a.date - 1),
thr AS (SELECT species, doy, quantile_cont(obs, 0.9) AS threshold FROM df GROUP BY ALL)"""
)


@query(f"WITH {FRAME} SELECT species::BIGINT AS species, row, date::VARCHAR AS date, obs, round(pred, 6) AS pred, round(coverage, 6) AS coverage, start_hour::BIGINT AS start_hour, era, round(phen, 6) AS phen FROM ev")
def verification_frame(spark, sf_dir):
    out = frame(spark, sf_dir).select("species", "row", "date", "obs", "pred", "coverage", "start_hour", "era", "phen")
    return a.written(a.rounded(out, "pred", "coverage", "phen"))


def _over(x: str, p: float) -> str:
    cu, co = f"max(CASE WHEN c_{x} <= {p} THEN c_{x} END)", f"min(CASE WHEN c_{x} > {p} THEN c_{x} END)"
    u, o = f"max(CASE WHEN c_{x} <= {p} THEN doy END)", f"min(CASE WHEN c_{x} > {p} THEN doy END)"
    return f"CASE WHEN sum({x}) > 0 THEN CASE WHEN {u} IS NULL THEN {o} WHEN {o} IS NULL THEN {u} ELSE {u} + ({p} - {cu}) / ({co} - {cu}) * ({o} - {u}) END END"


def _cdf(x: str) -> str:
    return f"sum({x}) OVER (PARTITION BY species, scope, year ORDER BY doy ROWS UNBOUNDED PRECEDING) / nullif(sum({x}) OVER (PARTITION BY species, scope, year), 0) AS c_{x}"


_SKILL = "CASE WHEN {r} <> 0 THEN 1 - {s} / {r} END"
LEVELS = f"""
ev2 AS (SELECT *, unnest(['overall', era]) AS scope FROM ev), df2 AS (SELECT *, unnest(['overall', era]) AS scope FROM df),
r1 AS (SELECT species, scope, count(*) AS n_rows, avg(abs(pred - obs)) AS mae, avg(pred - obs) AS bias, avg(abs(phen - obs)) AS mae_phen FROM ev2 GROUP BY ALL),
r2 AS (SELECT species, scope, avg(abs(persistence - obs)) AS mae_persistence, avg(abs(pred - obs)) AS mae_daily FROM df2 WHERE persistence IS NOT NULL GROUP BY ALL),
k AS (SELECT species, scope, obs >= threshold AS o, pred >= threshold AS p, persistence >= threshold AS b, persistence IS NOT NULL AS known FROM df2 JOIN thr USING (species, doy) WHERE threshold > 0),
e1 AS (SELECT species, scope, count(*) FILTER (WHERE o AND p) AS hits, count(*) FILTER (WHERE o AND NOT p) AS misses, count(*) FILTER (WHERE NOT o AND p) AS fa, count(*) AS n, avg(o::INT) AS rate,
  count(*) FILTER (WHERE known AND o AND b) / nullif(count(*) FILTER (WHERE known AND (o OR b)), 0) AS csi_b FROM k GROUP BY ALL),
e2 AS (SELECT *, hits / nullif(hits + misses + fa, 0) AS csi FROM e1),
g1 AS (SELECT species, date, era FROM wh GROUP BY ALL HAVING count(DISTINCT row) >= 6 AND max((e - s) / 60.0::DOUBLE) <= 1.5),
g2 AS (SELECT species, date, era, h AS hour, sum(obs * mask) / sum(mask) AS obs, any_value(pred_hour) AS pred FROM wh JOIN g1 USING (species, date, era) GROUP BY ALL),
g3 AS (SELECT *, count(*) OVER (PARTITION BY species, date) AS hours FROM g2),
g4 AS (SELECT *, sum(obs) OVER o / nullif(sum(obs) OVER d, 0) AS co, sum(pred) OVER o / nullif(sum(pred) OVER d, 0) AS cp FROM g3 WHERE hours >= 6 WINDOW d AS (PARTITION BY species, date), o AS (PARTITION BY species, date ORDER BY hour ROWS UNBOUNDED PRECEDING)),
g5 AS (SELECT species, date, era, sum(abs(co - cp)) AS emd, abs(arg_min(hour, [-obs, hour]) - arg_min(hour, [-pred, hour])) AS peak FROM g4 GROUP BY ALL HAVING sum(obs) > 0),
g6 AS (SELECT *, unnest(['overall', era]) AS scope FROM g5),
sh AS (SELECT species, scope, count(*) AS n, avg(peak) AS peak_mae, avg((peak <= 1)::INT) AS near, avg(emd) AS emd FROM g6 GROUP BY ALL),
c AS (SELECT *, {_cdf("obs")}, {_cdf("pred")} FROM df2),
y AS (SELECT species, scope, year, CASE WHEN sum(obs) > 0 THEN sum(pred) / sum(obs) END AS ratio, {_over("pred", 0.5)} - {_over("obs", 0.5)} AS error FROM c GROUP BY ALL),
se AS (SELECT species, scope, count(*) AS n, avg(abs(error)) AS date_mae, avg(ratio) AS ratio FROM y GROUP BY ALL)"""

#: The columns of the table of scopes: those of the first page, then those for diagnosis.
SCOPE_TABLE = (
    "n_rows", "mae", "bias", "mae_skill_phen", "mae_skill_persistence", "event_csi", "event_csi_skill_persistence", "shape_peak_hour_mae", "shape_emd", "season_median_date_mae", "season_total_ratio",
    "event_n_days", "event_base_rate", "event_hits", "event_misses", "event_false_alarms", "event_pod", "event_far", "event_csi_persistence", "mae_phen", "mae_persistence", "shape_n_days", "shape_peak_hour_within_1h",
)


@query(f"""WITH {FRAME}, {LEVELS}
SELECT r1.species::BIGINT AS species, r1.scope, n_rows, round(mae, 6) AS mae, round(bias, 6) AS bias, round({_SKILL.format(s="mae", r="mae_phen")}, 6) AS mae_skill_phen, round({_SKILL.format(s="mae_daily", r="mae_persistence")}, 6) AS mae_skill_persistence,
  round(csi, 6) AS event_csi, round(CASE WHEN csi_b <> 1 THEN (csi - csi_b) / (1 - csi_b) END, 6) AS event_csi_skill_persistence, round(sh.peak_mae, 6) AS shape_peak_hour_mae, round(sh.emd, 6) AS shape_emd,
  round(se.date_mae, 4) AS season_median_date_mae, round(se.ratio, 6) AS season_total_ratio, e2.n AS event_n_days, round(e2.rate, 6) AS event_base_rate, hits AS event_hits, misses AS event_misses, fa AS event_false_alarms,
  round(hits / nullif(hits + misses, 0), 6) AS event_pod, round(fa / nullif(hits + fa, 0), 6) AS event_far, round(csi_b, 6) AS event_csi_persistence, round(mae_phen, 6) AS mae_phen, round(mae_persistence, 6) AS mae_persistence,
  sh.n AS shape_n_days, round(sh.near, 6) AS shape_peak_hour_within_1h
FROM r1 LEFT JOIN r2 USING (species, scope) LEFT JOIN e2 USING (species, scope) LEFT JOIN sh USING (species, scope) LEFT JOIN se USING (species, scope)""")
def metric_all(spark, sf_dir):
    """The table of scopes: all 23 measures of each species, overall and by era, from one call."""
    rows = frame(spark, sf_dir)
    thresholds = survey.daily_frame(rows).groupBy("species", "doy").agg(F.percentile("obs", F.lit(0.9)).alias("threshold"))
    out = scoring.evaluate(rows, thresholds).select("species", "scope", *SCOPE_TABLE)
    out = a.rounded(out, "season_median_date_mae", digits=4)
    return a.written(a.rounded(out, *[c for c, k in out.dtypes if k == "double" and c != "season_median_date_mae"]))


@query(f"WITH {FRAME} SELECT species::BIGINT AS species, year::BIGINT AS year, round(corr(obs, pred), 6) AS pearson, round(1 - sum((obs - pred) ^ 2) / nullif(var_pop(obs) * count(*), 0), 6) AS r_squared FROM df GROUP BY ALL")
def yearly_agreement(spark, sf_dir):
    return a.written(a.rounded(scoring.yearly_agreement(survey.daily_frame(frame(spark, sf_dir))), "pearson", "r_squared"))


@query(f"WITH {SURVEYS} SELECT species::BIGINT AS species, date::VARCHAR AS date, row, min(h)::BIGINT AS first_hour, (max(h) + 1)::BIGINT AS last_hour, any_value(obs) AS obs FROM wh GROUP BY ALL")
def day_segments(spark, sf_dir):
    return a.written(explore.day_segments(surveys(spark, sf_dir)))


@query(f"WITH {SURVEYS} SELECT species::BIGINT AS species, date::VARCHAR AS date, h::BIGINT AS hour, round(least(sum(mask), 1), 6) AS coverage FROM wh GROUP BY ALL")
def day_coverage(spark, sf_dir):
    return a.written(a.rounded(explore.day_coverage(surveys(spark, sf_dir)), "coverage"))


@query(f"""{_SHAPE}, n AS (SELECT species, list_sort(list(DISTINCT doy)) AS d FROM sh GROUP BY species), t AS (SELECT species, d[1] AS a, d[len(d) // 2 + 1] AS b, d[-1] AS c FROM n), l AS (SELECT species, 'first' AS line, a AS doy FROM t UNION ALL SELECT species, 'middle', b FROM t UNION ALL SELECT species, 'last', c FROM t)
SELECT species::BIGINT AS species, line, doy::BIGINT AS doy, hour::BIGINT AS hour, round(shape, 6) AS shape FROM sh JOIN l USING (species, doy)""")
def shape_lines(spark, sf_dir):
    return a.written(a.rounded(climatology.shape_lines(shapes(spark, sf_dir)).select("species", "line", "doy", "hour", "shape"), "shape"))


_CLEAN = f"""WITH {a.INTERVALS}, f AS (SELECT *, id % 3 <> 0 AS timed FROM ti), q AS (SELECT date, s, e, count(*) AS n, count(*) FILTER (WHERE NOT timed) AS u FROM f GROUP BY ALL),
x AS (SELECT date, s, e FROM q WHERE e - s > 120 AND u / n < 0.5), kept AS (SELECT f.* FROM f LEFT JOIN x ON f.date = x.date AND f.s = x.s AND f.e = x.e WHERE timed OR x.s IS NULL)"""


@query(f"{_CLEAN} SELECT id FROM kept WHERE NOT (s < 300 OR e > 1200 OR e - s > 420)")
def clean_records(spark, sf_dir):
    """Records without those that nothing places in an expanded period, nor those of suspicious periods."""
    minutes = lambda m: F.date_trunc("day", "start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(m), F.lit(0))
    records = a.intervals(spark, sf_dir).withColumns({"seen": F.when(F.col("id") % 3 != 0, F.col("start")), "opens": minutes(300), "closes": minutes(1200)})
    kept = survey.without_untimed(records, survey.expandable(survey.period_statistics(records)))
    odd = survey.suspicious(kept, 7.0, "opens", "closes")
    return kept.join(odd.select("id"), "id", "left_anti").select("id")


@query(f"WITH {a.INTERVALS}, b AS (SELECT DISTINCT date, s, e FROM ti WHERE count > 0) SELECT id FROM ti WHERE count = 0 AND (date, s, e) NOT IN (SELECT (date, s, e) FROM b)".replace("(date, s, e) NOT IN (SELECT (date, s, e) FROM b)", "NOT EXISTS (SELECT 1 FROM b WHERE b.date = ti.date AND b.s = ti.s AND b.e = ti.e)"))
def empty_periods(spark, sf_dir):
    """Surveys noted as without birds whose exact period has none in any other record."""
    iv = a.intervals(spark, sf_dir)
    return survey.same_interval(iv.where(F.col("count") == 0), iv.where(F.col("count") > 0), keep=False).select("id")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey % 5 IN (1, 3) AND s_suppkey % 4 <> 0")
def kept_taxa(spark, sf_dir):
    taxa = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("family "), F.col("s_nationkey") % 5).alias("family"), F.when(F.col("s_suppkey") % 4 != 0, "species").otherwise("form").alias("category"))
    return survey.kept_taxa(taxa, ("family 1", "family 3")).select("id", "name")


@query(f"WITH {a.STATION} SELECT location, count(*)::BIGINT AS n_hours, count(DISTINCT date)::BIGINT AS n_days, round(sum(v2), 4) AS v2 FROM wx GROUP BY location")
def cache_backfill(spark, sf_dir):
    """A cache that ends in the middle of its trailing block, filled to the end: each hour is there once."""
    hours = a.station_hours(spark, sf_dir).withColumn("datetime", F.to_timestamp(F.col("date")) + F.make_dt_interval(F.lit(0), F.col("hour"), F.lit(0), F.lit(0))).select("location", "datetime", "v2")
    span = hours.agg(F.to_date(F.min("datetime")), F.to_date(F.max("datetime")), F.sort_array(F.collect_set("location"))).first()
    to = cache.shared_folder(spark, "backfill")
    if span[0] is None:
        return hours.groupBy("location").agg(F.count("*").alias("n_hours"), F.count("*").alias("n_days"), F.sum("v2").alias("v2"))

    def fetch(locations, lo, hi):
        day = F.to_date("datetime")
        return hours.where(F.col("location").isin(locations) & (day >= F.lit(lo).cast("date")) & (day <= F.lit(hi).cast("date")))

    for end in (span[0] + (span[1] - span[0]) // 2, span[1], span[1]):
        cache.backfill(spark, to, span[2], span[0], end, 1, fetch)
    out = cache.load(spark, to, span[2], ["v2"])
    return a.rounded(out.groupBy("location").agg(F.count("*").alias("n_hours"), F.countDistinct(F.to_date("datetime")).alias("n_days"), F.sum("v2").alias("v2")), "v2", digits=4)


@query(f"{_YEARS}, w AS (SELECT date, sum(value) AS v FROM (SELECT DISTINCT o_orderdate::DATE AS date, 1.0 AS value FROM orders) GROUP BY date) SELECT hs.date::VARCHAR AS date, count(*)::BIGINT AS n, max(v)::DOUBLE AS v FROM hs JOIN ys USING (year) JOIN w ON hs.date = w.date WHERE tvt = 'train' GROUP BY hs.date")
def split_samples(spark, sf_dir):
    """Training rows beside the weather of their date, of dates that have any."""
    weather = a.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().withColumn("v", F.lit(1.0))
    rows = a.hour_surveys(spark, sf_dir).join(F.broadcast(years(spark, sf_dir).select("year", "tvt")), "year")
    known = rows.join(weather.select("date"), "date", "left_semi")
    return a.written(explore.assembled(known, weather, "train").groupBy("date").agg(F.count("*").alias("n"), F.max("v").alias("v")))


@query(f"{_YEARS} SELECT tvt, count(*) FILTER (WHERE era = 'early')::BIGINT AS early, count(*) FILTER (WHERE era = 'middle')::BIGINT AS middle, count(*) FILTER (WHERE era = 'late')::BIGINT AS late FROM hs JOIN ys USING (year) GROUP BY tvt")
def split_by_era(spark, sf_dir):
    rows = a.hour_surveys(spark, sf_dir).join(F.broadcast(years(spark, sf_dir).select("year", "tvt")), "year").withColumn("era", a.era_column())
    return explore.split_by_era(rows, a.ERA_LABELS)


_DAYS = range(1, 367)


@query(f"WITH {a.HOURS} SELECT year::BIGINT AS year, {', '.join(f'round(avg(rate) FILTER (WHERE doy = {d}), 6) AS d{d}' for d in _DAYS)} FROM hs GROUP BY year")
def pivot_mean_rate(spark, sf_dir):
    out = explore.year_by_doy(a.hour_surveys(spark, sf_dir), F.avg("rate"))
    return a.written(a.rounded(out, *[f"d{d}" for d in _DAYS]))


@query(f"WITH {a.HOURS}, t AS (SELECT year, date, doy, sum(count)::DOUBLE AS count FROM hs GROUP BY ALL) SELECT year::BIGINT AS year, {', '.join(f'median(count) FILTER (WHERE doy = {d}) AS d{d}' for d in _DAYS)} FROM t GROUP BY year")
def pivot_median_count(spark, sf_dir):
    days = a.hour_surveys(spark, sf_dir).groupBy("year", "date", "doy").agg(F.sum("count").cast("double").alias("count"))
    return a.written(explore.year_by_doy(days, F.percentile("count", F.lit(0.5))))


@query(f"WITH {a.STATION}, d AS (SELECT location, date, avg(v1) AS v1 FROM wx WHERE dayofyear(date) % 4 <> 0 GROUP BY ALL), c AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM d), l AS (SELECT DISTINCT location FROM d) SELECT l.location, c.date::VARCHAR AS date, round(v1, 6) AS v1 FROM l CROSS JOIN c LEFT JOIN d ON d.location = l.location AND d.date = c.date")
def wx_gapless(spark, sf_dir):
    days = a.station_hours(spark, sf_dir).where(F.dayofyear("date") % 4 != 0).groupBy("location", "date").agg(F.avg("v1").alias("v1"))
    return a.written(a.rounded(cube.gapless(days), "v1"))


@query(f"WITH {a.HOURS}, m AS (SELECT avg(rate) AS m, stddev_samp(rate) AS s FROM dy) SELECT species::BIGINT AS species, round(avg(log10(1 + count)), 6) AS log_count, round(avg(doy / 365.0::DOUBLE), 6) AS doy_share, round(avg((year - 2000) / 100.0::DOUBLE), 6) AS year_share, round(avg((rate - m) / s), 6) AS z FROM dy, m GROUP BY species")
def trial_inputs(spark, sf_dir):
    d = a.daily(spark, sf_dir)
    stats = d.agg(F.avg("rate").alias("m"), F.stddev_samp("rate").alias("s"))
    x = d.crossJoin(F.broadcast(stats)).withColumns({**trial_features(F.col("count"), F.col("doy"), F.col("year")), "z": z_score(F.col("rate"), F.col("m"), F.col("s"))})
    names = ("log_count", "doy_share", "year_share", "z")
    return a.written(a.rounded(x.groupBy("species").agg(*[F.avg(c).alias(c) for c in names]), *names))


@query(f"WITH {a.INTERVALS}, v AS (SELECT id, CASE WHEN id % 10 = 0 THEN e ELSE s END AS s, CASE WHEN id % 10 = 0 THEN s ELSE e END AS e FROM ti), p AS (SELECT id, h, greatest(s, 60 * h) AS a, least(e, 60 * (h + 1)) AS b FROM v CROSS JOIN range(30) r(h)) SELECT id, a::BIGINT AS from_minute, (b - a)::BIGINT AS minutes FROM p WHERE a < b")
def inverted_intervals(spark, sf_dir):
    """Hours of intervals of which every tenth ends before it starts: these have none."""
    iv, turned = a.intervals(spark, sf_dir), F.col("id") % 10 == 0
    iv = iv.withColumns({"start": F.when(turned, F.col("end")).otherwise(F.col("start")), "end": F.when(turned, F.col("start")).otherwise(F.col("end"))})
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    day = F.unix_seconds(F.date_trunc("day", F.col("date").cast("timestamp")))
    return intervals.hourly(iv).select("id", ((seconds("part_start") - day) / 60).cast("long").alias("from_minute"), ((seconds("part_end") - seconds("part_start")) / 60).cast("long").alias("minutes"))
