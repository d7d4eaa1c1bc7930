"""Queries for exploring, splitting, fitting and combining tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import POWERS
from ..operators import explore, fitting, training, survey
from . import adapters as a
from . import query

_H = f"WITH {a.HOURS}"
_ERA = "CASE WHEN year < 1997 THEN 'early' WHEN year < 2000 THEN 'middle' ELSE 'late' END"
_YEARS = f"""{_H}, yr AS (SELECT DISTINCT year, {_ERA} AS era FROM hs), yk AS (SELECT *, row_number() OVER (PARTITION BY era ORDER BY (year * 7919) % 101, year) - 1 AS i, count(*) OVER (PARTITION BY era) AS n FROM yr),
ys AS (SELECT year, era, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.9) THEN 'val' ELSE 'test' END AS tvt FROM yk)"""


def years(spark, sf_dir):
    hs = a.hour_surveys(spark, sf_dir)
    return explore.keyed_years_split(hs.select("year").distinct().withColumn("era", a.era_column()))


@query(f"{_YEARS} SELECT year::BIGINT AS year, era, tvt FROM ys")
def split_period(spark, sf_dir):
    return a.written(years(spark, sf_dir))


_RANDOM = "CASE WHEN (species * 100000 + datediff('day', DATE '1990-01-01', date) * 24 + hour) * 2654435761 % 1000003 % 1000 < 700 THEN 'train' WHEN (species * 100000 + datediff('day', DATE '1990-01-01', date) * 24 + hour) * 2654435761 % 1000003 % 1000 < 900 THEN 'val' ELSE 'test' END"


@query(f"{_H} SELECT {_RANDOM} AS tvt, count(*)::BIGINT AS n FROM hs GROUP BY 1")
def split_random(spark, sf_dir):
    key = F.col("species").cast("long") * 100000 + F.datediff("date", F.lit("1990-01-01").cast("date")) * 24 + F.col("hour")
    return a.hour_surveys(spark, sf_dir).groupBy(explore.keyed_split(key).alias("tvt")).agg(F.count("*").alias("n"))


@query(f"{_YEARS} SELECT tvt, count(*)::BIGINT AS n_rows, count(DISTINCT date)::BIGINT AS n_dates, count(DISTINCT hs.year)::BIGINT AS n_years, round(avg((count = 0)::INT), 6) AS zero_share, round(avg(duration), 6) AS mean_duration FROM hs JOIN ys ON hs.year = ys.year GROUP BY tvt")
def split_summary(spark, sf_dir):
    hs = a.hour_surveys(spark, sf_dir).join(F.broadcast(years(spark, sf_dir).select("year", "tvt")), "year")
    return a.rounded(explore.split_summary(hs), "zero_share", "mean_duration")


@query(f"{_YEARS} SELECT tvt, CASE WHEN min(hs.year) = max(hs.year) THEN min(hs.year)::VARCHAR ELSE min(hs.year)::VARCHAR || '-' || max(hs.year)::VARCHAR END AS years, count(*)::BIGINT AS n FROM hs JOIN ys ON hs.year = ys.year GROUP BY tvt")
def run_info(spark, sf_dir):
    hs = a.hour_surveys(spark, sf_dir).join(F.broadcast(years(spark, sf_dir).select("year", "tvt")), "year")
    return hs.groupBy("tvt").agg(explore.years_range(F.col("year")).alias("years"), F.count("*").alias("n"))


@query(f"{_H} SELECT year::BIGINT AS year, {', '.join(f'round(coalesce(sum(duration) FILTER (WHERE doy = {d}), 0), 4) AS d{d}' for d in range(1, 367))} FROM hs GROUP BY year")
def pivot_year_doy(spark, sf_dir):
    out = explore.year_by_doy(a.hour_surveys(spark, sf_dir), F.sum("duration"), empty=0.0)
    return a.written(a.rounded(out, *[c for c in out.columns if c != "year"], digits=4))


@query(f"{_H} SELECT year::BIGINT AS year, round(avg(rate), 6) AS rate, median(rate) AS median_rate FROM hs GROUP BY year")
def year_mean_rate(spark, sf_dir):
    return a.written(a.rounded(a.hour_surveys(spark, sf_dir).groupBy("year").agg(F.avg("rate").alias("rate"), F.percentile("rate", F.lit(0.5)).alias("median_rate")), "rate"))


@query(f"{_H} SELECT species::BIGINT AS species, date::VARCHAR AS date, hour::BIGINT AS hour, rate FROM hs ORDER BY rate DESC, date, species, hour LIMIT 10")
def topk_rate(spark, sf_dir):
    return a.written(explore.top_rates(a.hour_surveys(spark, sf_dir), 10, "date", "species", "hour").select("species", "date", "hour", "rate"))


@query(f"{_H}, t AS (SELECT max(rate) AS top FROM dy) SELECT least(floor(rate / top * 59) + 1, 59)::BIGINT AS bin, count(*)::BIGINT AS n FROM dy, t GROUP BY 1")
def rate_histogram(spark, sf_dir):
    return explore.histogram(a.daily(spark, sf_dir), "rate")


@query(f"WITH {a.EVALUATION} SELECT species::BIGINT AS species, round(regr_slope(ln(1 + pred), ln(1 + obs)), 6) AS slope, round(regr_intercept(ln(1 + pred), ln(1 + obs)), 6) AS intercept FROM ev GROUP BY species")
def ols_fit(spark, sf_dir):
    x, y = F.log1p("obs"), F.log1p("pred")
    return a.written(a.rounded(a.evaluation(spark, sf_dir).groupBy("species").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")), "slope", "intercept"))


@query(f"{_H}, m AS (SELECT species, doy, avg(rate) AS mean FROM dy GROUP BY ALL) SELECT m.species::BIGINT AS species, arg_min(doy, [-mean, doy])::BIGINT AS peak_doy, round(max(mean), 6) AS peak_mean, round(avg(mean), 6) AS season_mean, (SELECT count(DISTINCT date) FROM dy)::BIGINT AS n_days FROM m GROUP BY m.species")
def season_summary(spark, sf_dir):
    d = a.daily(spark, sf_dir)
    means = d.groupBy("species", "doy").agg(F.avg("rate").alias("mean"))
    out = means.groupBy("species").agg(F.max_by("doy", F.struct("mean", -F.col("doy"))).alias("peak_doy"), F.max("mean").alias("peak_mean"), F.avg("mean").alias("season_mean"))
    n = d.groupBy("species").agg(F.countDistinct("date").alias("n_days"))
    return a.written(a.rounded(out.join(n, "species"), "peak_mean", "season_mean"))


@query(f"WITH {a.EVALUATION} SELECT doy::BIGINT AS doy, round(sum(obs), 4) AS obs, round(sum(pred), 4) AS pred FROM ev GROUP BY doy")
def doy_totals(spark, sf_dir):
    return a.written(a.rounded(a.evaluation(spark, sf_dir).groupBy("doy").agg(F.sum("obs").alias("obs"), F.sum("pred").alias("pred")), "obs", "pred", digits=4))


@query(f"WITH {a.EVALUATION} SELECT species::BIGINT AS species, date::VARCHAR AS date, round(sum(exp(ln(1 + pred)) - 1), 4) AS total FROM ev GROUP BY species, date")
def forecast_totals(spark, sf_dir):
    ev = a.evaluation(spark, sf_dir).withColumn("log_count", F.log1p("pred"))
    return a.written(a.rounded(ev.groupBy("species", "date").agg(F.sum(F.expm1("log_count")).alias("total")), "total", digits=4))


@query("SELECT s_suppkey AS species, s_name AS name, n_name AS family FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def taxonomy_join(spark, sf_dir):
    nation = a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("species_family"), F.col("n_name").alias("family"))
    s = a.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("species"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("species_family"))
    return survey.with_taxonomy(s, nation, "species_family").select("species", "name", "family")


@query("SELECT CASE WHEN l_suppkey % 11 < 4 THEN 'mapped ' || (l_suppkey % 11 % 2) ELSE (l_suppkey % 11)::VARCHAR END AS species, CASE WHEN l_suppkey % 11 < 4 THEN 0 ELSE 1 END AS raw, sum(l_quantity) AS count FROM lineitem GROUP BY ALL".replace("CASE WHEN l_suppkey % 11 < 4 THEN 0 ELSE 1 END AS raw, ", ""))
def merged_species(spark, sf_dir):
    rows = a.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 11).cast("string").alias("species"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("count"))
    taxonomy = spark.createDataFrame([(str(i), f"mapped {i % 2}") for i in range(4)], "species string, name string")
    return survey.merged_species(rows, taxonomy, ("date",)).groupBy("species").agg(F.sum("count").alias("count"))


@query(f"{_H} SELECT species::BIGINT AS species, count(*)::BIGINT AS n FROM cnt GROUP BY species ORDER BY n DESC, species")
def species_value_counts(spark, sf_dir):
    return a.written(a.hour_counts(spark, sf_dir).groupBy("species").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "species"))


@query("SELECT DISTINCT l_shipdate::DATE::VARCHAR AS date FROM lineitem UNION SELECT DISTINCT o_orderdate::DATE::VARCHAR FROM orders")
def set_union_distinct(spark, sf_dir):
    x = a.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return a.written(x.unionByName(a.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))).dropDuplicates())


@query("SELECT l_shipdate::DATE::VARCHAR AS date FROM lineitem INTERSECT SELECT o_orderdate::DATE::VARCHAR FROM orders")
def dates_intersect(spark, sf_dir):
    x = a.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return a.written(x.intersect(a.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))))


@query(f"{_H} SELECT species::BIGINT AS species, round(avg(ln(1 + rate)), 6) AS log1p, round(avg(sqrt(rate)), 6) AS sqrt, round(avg(sqrt(rate) / 10), 6) AS sqrt_tenth, round(avg(pow(rate, 0.25)), 6) AS fourth_root, round(avg(pow(rate, 1 / 3.0)), 6) AS cube_root FROM hs GROUP BY species")
def power_transforms(spark, sf_dir):
    out = a.hour_surveys(spark, sf_dir).groupBy("species").agg(*[F.avg(f(F.col("rate"))).alias(n) for n, f in POWERS.items()])
    return a.written(a.rounded(out, *POWERS))


@query("SELECT event_type AS variable, round(avg(abs(value - 50)), 6) AS attribution FROM events GROUP BY event_type")
def attribution_means(spark, sf_dir):
    e = a.table(spark, sf_dir, "events").select(F.col("event_type").alias("variable"), (F.col("value") - 50).alias("attribution"))
    return a.rounded(explore.mean_attribution(e, "variable"), "attribution")


@query()
def weighted_days(spark, sf_dir):
    """50 draws of days of every species, by the logarithm of the day's rate."""
    days = a.daily(spark, sf_dir).select("species", "date", F.log1p("rate").alias("weight"))
    return explore.weighted_sample(days, "weight", "date", 50, by=("species",))


@query()
def ratio_gam(spark, sf_dir):
    """species, doy, hour and ratio of a penalised spline surface fitted to the hourly ratios of every species."""
    from ..operators.climatology import hourly_ratio

    samples = hourly_ratio(a.hour_surveys(spark, sf_dir), a.daily(spark, sf_dir))
    return fitting.ratio_surfaces(samples)


@query(f"""{_H}, rs AS (SELECT hs.species, hs.doy, hs.hour, hs.rate / nullif(dy.rate, 0) AS ratio, count(hs.rate) OVER (PARTITION BY hs.species, hs.date) AS n FROM hs JOIN dy ON hs.species = dy.species AND hs.date = dy.date),
ra AS (SELECT species, doy, hour, ratio FROM rs WHERE n > 1 AND ratio IS NOT NULL), m AS (SELECT *, avg(ratio) OVER (PARTITION BY species, hour) AS hourly, avg(ratio) OVER (PARTITION BY species, doy // 30, hour) AS monthly FROM ra)
SELECT species::BIGINT AS species, count(*)::BIGINT AS n, round(2 * sum(CASE WHEN ratio > 0 THEN ratio * ln(ratio / hourly) ELSE 0 END - (ratio - hourly)), 4) AS hourly,
  round(2 * sum(CASE WHEN ratio > 0 THEN ratio * ln(ratio / monthly) ELSE 0 END - (ratio - monthly)) FILTER (monthly > 0), 4) AS monthly FROM m WHERE hourly > 0 GROUP BY species""")
def ratio_deviance(spark, sf_dir):
    """Deviance of the hourly ratios from two fixed designs: a mean for each hour, and one for each hour of each month."""
    from ..operators.climatology import hourly_ratio

    samples = hourly_ratio(a.hour_surveys(spark, sf_dir), a.daily(spark, sf_dir)).withColumn("month", F.floor(F.col("doy") / 30))
    designs = (("hourly", ("species", "hour")), ("monthly", ("species", "month", "hour")))
    hourly, monthly = (fitting.poisson_deviance(samples, samples.groupBy(*on).agg(F.avg("ratio").alias("expected")), ("species",), on, name) for name, on in designs)
    return a.written(a.rounded(hourly.join(monthly.drop("n"), "species"), "hourly", "monthly", digits=4))


@query()
def ratio_surface_deviances(spark, sf_dir):
    """Deviance of the hourly ratios of every species from the surface with interaction, without it, and from hourly means."""
    from ..operators.climatology import hourly_ratio

    return fitting.surface_deviances(hourly_ratio(a.hour_surveys(spark, sf_dir), a.daily(spark, sf_dir)))


@query()
def trained_models(spark, sf_dir):
    """Coefficients trained by gradients for every species, with the rates, decays, weights and powers of the table of species, until none gains any more; the last year is held."""
    from ..registry import HYPERPARAMETERS
    from ..sources.cache import kept

    hs = kept(a.hour_surveys(spark, sf_dir), "training-surveys")
    last = hs.agg(F.max("year")).first()[0]
    rows = fitting.seasonal(hs).select("species", "count", F.col("duration").alias("exposure"), (F.col("year") == last).alias("held"), *fitting.FEATURES)
    numbered = spark.createDataFrame(list(enumerate(sorted(HYPERPARAMETERS))), "number int, name string")
    hyper = training.hyperparameters(spark).join(numbered, F.col("species") == F.col("name")).select(F.col("number").alias("species"), *training.HYPER)
    return training.train(rows, hyper, fitting.FEATURES)


@query()
def tweedie_fit(spark, sf_dir):
    """Coefficients of a Tweedie regression of the survey rate on season and hour, for every species."""
    return fitting.tweedie_coefficients(a.hour_surveys(spark, sf_dir), power=1.5)


@query()
def batch_prediction(spark, sf_dir):
    """Expected counts of each species, day and hour from the species' fitted regression, applied without leaving the JVM."""
    hs = a.hour_surveys(spark, sf_dir)
    return a.written(fitting.predict_each(fitting.fit_tweedie_each(hs, 1.5), hs).select("species", "date", "hour", "expected"))
