"""Queries on day-of-year climatologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import prior_logit_bias
from ..operators import climatology, ordered
from ..registry import QUANTILE_LEVELS
from . import adapters as a
from . import query

FIRST, LAST = 1, 366
_STATS = f"WITH {a.HOURS}, st AS (SELECT species, doy, min(rate) AS min, max(rate) AS max, avg(rate) AS mean, count(*) FILTER (WHERE rate > 0) AS n FROM dy GROUP BY ALL)"
_LEVELS = ", ".join(map(str, QUANTILE_LEVELS))
_SHARES = ", ".join(str(x / 100) for x in QUANTILE_LEVELS)
_QUANTILES = f"{_STATS}, qs AS (SELECT species, doy, quantile_cont(rate, [{_SHARES}]) AS q FROM dy GROUP BY ALL), ql AS (SELECT species, doy, unnest([{_LEVELS}]) AS level, unnest(q) AS quantile FROM qs)"
_GRID = f"{_STATS}, g AS (SELECT s.species, d.doy, st.min, st.max, st.mean, st.n FROM (SELECT DISTINCT species FROM st) s CROSS JOIN (SELECT unnest(range({FIRST}, {LAST} + 1))::INT AS doy) d LEFT JOIN st ON st.species = s.species AND st.doy = d.doy)"
_SMOOTH = f"{_GRID}, sm AS (SELECT species, doy, avg(min) OVER w AS min, avg(max) OVER w AS max, avg(mean) OVER w AS mean, avg(n) OVER w AS n FROM g WINDOW w AS (PARTITION BY species ORDER BY doy RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))"


def stats(spark, sf_dir):
    return climatology.doy_statistics(a.daily(spark, sf_dir))


def smooth_stats(spark, sf_dir):
    grid = climatology.full_grid(stats(spark, sf_dir), FIRST, LAST)
    return climatology.smoothed(grid, ("min", "max", "mean", "count_observations"))


def smooth_quantiles(spark, sf_dir):
    q = climatology.doy_quantiles(a.daily(spark, sf_dir), QUANTILE_LEVELS)
    return climatology.smoothed(q, ("quantile",), ("species", "level"))


@query(f"{_STATS} SELECT species::BIGINT AS species, doy::BIGINT AS doy, min, max, round(mean, 6) AS mean, n::BIGINT AS count_observations FROM st")
def phen_doy_stats(spark, sf_dir):
    return a.written(a.rounded(stats(spark, sf_dir), "mean"))


@query(f"{_QUANTILES} SELECT species::BIGINT AS species, doy::BIGINT AS doy, level::BIGINT AS level, round(quantile, 6) AS quantile FROM ql")
def phen_quantiles(spark, sf_dir):
    return a.written(a.rounded(climatology.doy_quantiles(a.daily(spark, sf_dir), QUANTILE_LEVELS), "quantile"))


@query(f"{_QUANTILES} SELECT species::BIGINT AS species, doy::BIGINT AS doy, level::BIGINT AS level, round(quantile, 6) AS quantile FROM ql")
def phen_quantiles_counted(spark, sf_dir):
    """The same quantiles by counting, no group's values in one task."""
    found = ordered.quantiles(a.daily(spark, sf_dir), ("species", "doy"), "rate", QUANTILE_LEVELS)
    return a.written(a.rounded(found.withColumn("level", F.col("level").cast("long")), "quantile"))


@query("""WITH busy AS (SELECT species, doy FROM (SELECT species, doy, s, avg(s) OVER (PARTITION BY species) AS m FROM (SELECT l_suppkey % 11 AS species, dayofyear(l_shipdate) AS doy, sum(l_quantity) AS s FROM lineitem GROUP BY ALL)) WHERE s > m),
ask AS (SELECT o_custkey % 11 AS species, dayofyear(o_orderdate) AS doy, count(*) AS n FROM orders GROUP BY ALL), last AS (SELECT species, max(doy) AS doy FROM busy GROUP BY species)
SELECT ask.species::BIGINT AS species, ask.doy::BIGINT AS doy, n::BIGINT AS n, coalesce(busy.doy, last.doy)::BIGINT AS known FROM ask ASOF LEFT JOIN busy ON ask.species = busy.species AND ask.doy <= busy.doy LEFT JOIN last ON last.species = ask.species""")
def phen_sparse_lookup(spark, sf_dir):
    """For each species and day asked for, the next day of more birds than usual, or the year's last."""
    days = a.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 11).alias("species"), F.dayofyear("l_shipdate").alias("doy")).agg(F.sum("l_quantity").alias("s"))
    busy = days.join(days.groupBy("species").agg(F.avg("s").alias("m")), "species").where("s > m").select("species", "doy")
    asked = a.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 11).alias("species"), F.dayofyear("o_orderdate").alias("doy"))
    found = ordered.with_next(asked, busy, ("species",), "doy")
    return a.written(found.groupBy("species", "doy").agg(F.count("*").alias("n"), F.max("known").alias("known")))


@query(f"{_SMOOTH} SELECT species::BIGINT AS species, doy::BIGINT AS doy, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(n, 4) AS count_observations FROM sm")
def phen_smooth(spark, sf_dir):
    return a.written(a.rounded(smooth_stats(spark, sf_dir), "min", "max", "mean", "count_observations", digits=4))


_QSMOOTH = f"{_QUANTILES}, qm AS (SELECT species, level, doy, avg(quantile) OVER (PARTITION BY species, level ORDER BY doy RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS quantile FROM ql)"


@query(f"{_QSMOOTH} SELECT species::BIGINT AS species, level::BIGINT AS level, doy::BIGINT AS doy, round(quantile, 4) AS quantile FROM qm")
def phen_quantile_smooth(spark, sf_dir):
    return a.written(a.rounded(smooth_quantiles(spark, sf_dir), "quantile", digits=4))


@query(f"""{_SMOOTH}, ql AS (SELECT species, doy, unnest([20, 70]) AS level, unnest(quantile_cont(rate, [0.2, 0.7])) AS quantile FROM dy GROUP BY species, doy),
r AS (SELECT unnest(range(-20, 421, 20))::BIGINT AS asked)
SELECT sm.species::BIGINT AS species, asked, greatest({FIRST}, least(asked, {LAST}))::BIGINT AS doy, round(sm.mean, 4) AS mean, round(l.quantile, 4) AS lower, round(u.quantile, 4) AS upper
FROM r JOIN sm ON sm.doy = greatest({FIRST}, least(asked, {LAST})) LEFT JOIN ql l ON l.species = sm.species AND l.doy = sm.doy AND l.level = 20 LEFT JOIN ql u ON u.species = sm.species AND u.doy = sm.doy AND u.level = 70""")
def phen_lookup(spark, sf_dir):
    asked = spark.range(-20, 421, 20).select(F.col("id").alias("asked"), climatology.clipped_doy(F.col("id"), FIRST, LAST).cast("int").alias("doy"))
    q = climatology.doy_quantiles(a.daily(spark, sf_dir), QUANTILE_LEVELS)
    level = lambda x, name: q.where(F.col("level") == climatology.nearest_level(x, QUANTILE_LEVELS)).select("species", "doy", F.col("quantile").alias(name))
    out = smooth_stats(spark, sf_dir).select("species", "doy", "mean").join(F.broadcast(asked), "doy")
    out = out.join(level(25, "lower"), ["species", "doy"], "left").join(level(75, "upper"), ["species", "doy"], "left")
    return a.written(a.rounded(out.select("species", "asked", "doy", "mean", "lower", "upper"), "mean", "lower", "upper", digits=4))


_SAMPLES = f"{_STATS}, rs AS (SELECT hs.species, hs.doy, hs.hour, hs.rate / nullif(dy.rate, 0) AS ratio, count(hs.rate) OVER (PARTITION BY hs.species, hs.date) AS n FROM hs JOIN dy ON hs.species = dy.species AND hs.date = dy.date), ra AS (SELECT species, doy, hour, ratio FROM rs WHERE n > 1 AND ratio IS NOT NULL)"
_RATES = f"{_SAMPLES}, rt AS (SELECT species, hour, avg(ratio) AS ratio FROM ra GROUP BY ALL), hr AS (SELECT st.species, st.doy, h.hour, CASE WHEN h.hour BETWEEN 6 AND 17 THEN coalesce(ratio * mean, 0) ELSE 0 END AS rate FROM st CROSS JOIN (SELECT unnest(range(24))::INT AS hour) h LEFT JOIN rt ON rt.species = st.species AND rt.hour = h.hour)"


def ratio_table(spark, sf_dir):
    samples = climatology.hourly_ratio(a.hour_surveys(spark, sf_dir), a.daily(spark, sf_dir))
    return samples.groupBy("species", "hour").agg(F.avg("ratio").alias("ratio"))


def hour_rates(spark, sf_dir):
    return climatology.hourly_rate(stats(spark, sf_dir).select("species", "doy", "mean"), ratio_table(spark, sf_dir))


@query(f"{_SAMPLES} SELECT species::BIGINT AS species, hour::BIGINT AS hour, count(*)::BIGINT AS n, round(avg(ratio), 6) AS ratio FROM ra GROUP BY species, hour")
def ratio_samples(spark, sf_dir):
    samples = climatology.hourly_ratio(a.hour_surveys(spark, sf_dir), a.daily(spark, sf_dir))
    return a.written(a.rounded(samples.groupBy("species", "hour").agg(F.count("*").alias("n"), F.avg("ratio").alias("ratio")), "ratio"))


@query(f"{_RATES} SELECT species::BIGINT AS species, doy::BIGINT AS doy, hour::BIGINT AS hour, round(rate, 4) AS rate FROM hr")
def phen_hourly_rate(spark, sf_dir):
    return a.written(a.rounded(hour_rates(spark, sf_dir), "rate", digits=4))


_NIGHT = "(doy < 60 OR doy > 300) AND (hour <= 6 OR hour >= 17)"
_SHAPE = f"{_RATES}, dk AS (SELECT species, doy, hour, CASE WHEN {_NIGHT} THEN 0 ELSE rate END AS rate FROM hr), sh AS (SELECT species, doy, hour, CASE WHEN sum(rate) OVER w > 0 THEN rate / sum(rate) OVER w WHEN hour BETWEEN 6 AND 17 THEN 1 / 12.0::DOUBLE ELSE 0 END AS shape FROM dk WINDOW w AS (PARTITION BY species, doy))"


def shapes(spark, sf_dir):
    night = spark.range(1, 367).select(F.col("id").cast("int").alias("doy"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")).withColumn("night", F.expr(_NIGHT))
    return climatology.hourly_shape(hour_rates(spark, sf_dir), night)


@query(f"{_SHAPE} SELECT species::BIGINT AS species, doy::BIGINT AS doy, hour::BIGINT AS hour, round(shape, 6) AS shape FROM sh")
def phen_hourly_shape(spark, sf_dir):
    return a.written(a.rounded(shapes(spark, sf_dir), "shape"))


@query(f"""{_SHAPE}, pk AS (SELECT *, max(shape) OVER (PARTITION BY species, doy) AS top FROM sh)
SELECT species::BIGINT AS species, doy::BIGINT AS doy, hour::BIGINT AS hour, round(ln(shape / greatest(top, 1e-6) * 0.5 + 1e-6) - ln(1 - shape / greatest(top, 1e-6) * 0.5 + 1e-6), 4) AS bias FROM pk""")
def prior_bias(spark, sf_dir):
    days = shapes(spark, sf_dir).groupBy("species", "doy").agg(F.array_sort(F.collect_list(F.struct("hour", "shape"))).alias("s"))
    out = days.select("species", "doy", F.posexplode(prior_logit_bias(F.transform("s", lambda x: x["shape"]))).alias("hour", "bias"))
    return a.written(a.rounded(out, "bias", digits=4))


_CSI = f"""WITH {a.EVALUATION}, t AS (SELECT species, doy, avg(threshold) OVER (PARTITION BY species ORDER BY doy RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS threshold FROM thr),
x AS (SELECT df.species, obs >= threshold AS o, pred >= threshold AS p FROM df JOIN t ON df.species = t.species AND df.doy = t.doy WHERE threshold > 0)
SELECT species::BIGINT AS species, count(*) FILTER (WHERE o AND p)::BIGINT AS hits, count(*) FILTER (WHERE o AND NOT p)::BIGINT AS misses, count(*) FILTER (WHERE NOT o AND p)::BIGINT AS false_alarms,
round(count(*) FILTER (WHERE o AND p) / nullif(count(*) FILTER (WHERE o OR p), 0), 6) AS csi FROM x GROUP BY species"""


@query(_CSI)
def flagship_event_csi(spark, sf_dir):
    """Zero-filled surveys to daily rates, smoothed 90 % levels by day of year, and the events above them."""
    from ..functions.scores import contingency
    from ..operators import survey

    daily = survey.daily_frame(a.evaluation(spark, sf_dir))
    levels = climatology.smoothed(a.thresholds(spark, sf_dir), ("threshold",))
    days = daily.join(levels, ["species", "doy"]).where("threshold > 0")
    c = contingency(F.col("obs") >= F.col("threshold"), F.col("pred") >= F.col("threshold"))
    return a.written(a.rounded(days.groupBy("species").agg(*[c[k].alias(k) for k in ("hits", "misses", "false_alarms", "csi")]), "csi"))
