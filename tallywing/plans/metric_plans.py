"""Queries that score the surrogate prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import scoring, survey, training
from ..registry import HYPERPARAMETERS
from . import adapters as a
from . import query

_E = f"WITH {a.EVALUATION}"
_SKILL = "CASE WHEN {r} <> 0 THEN 1 - {s} / {r} END"
_HIGHER = "CASE WHEN {r} <> 1 THEN ({s} - {r}) / (1 - {r}) END"


def frames(spark, sf_dir):
    frame = a.evaluation(spark, sf_dir)
    return frame, survey.daily_frame(frame)


def _row_sql(by: str, rows: str, days: str) -> str:
    return f"""r AS (SELECT {by}, count(*) AS n_rows, avg(abs(pred - obs)) AS mae, avg(pred - obs) AS bias, avg(abs(phen - obs)) AS mae_phen FROM {rows} GROUP BY ALL),
d AS (SELECT {by}, avg(abs(persistence - obs)) AS mae_persistence, avg(abs(pred - obs)) AS mae_daily FROM {days} WHERE persistence IS NOT NULL GROUP BY ALL)"""


_ROW_OUT = f"""n_rows::BIGINT AS n_rows, round(mae, 6) AS mae, round(bias, 6) AS bias, round(mae_phen, 6) AS mae_phen, round(mae_persistence, 6) AS mae_persistence, round(mae_daily, 6) AS mae_daily,
round({_SKILL.format(s="mae", r="mae_phen")}, 6) AS mae_skill_phen, round({_SKILL.format(s="mae_daily", r="mae_persistence")}, 6) AS mae_skill_persistence"""
_ROW_COLUMNS = ("mae", "bias", "mae_phen", "mae_persistence", "mae_daily", "mae_skill_phen", "mae_skill_persistence")


@query(f"{_E}, {_row_sql('species', 'ev', 'df')} SELECT species::BIGINT AS species, {_ROW_OUT} FROM r LEFT JOIN d USING (species)")
def metric_row(spark, sf_dir):
    return a.written(a.rounded(scoring.row_level(*frames(spark, sf_dir)), *_ROW_COLUMNS))


_EV2 = "ev2 AS (SELECT *, unnest(['overall', era]) AS scope FROM ev), df2 AS (SELECT *, unnest(['overall', era]) AS scope FROM df)"


@query(f"{_E}, {_EV2}, {_row_sql('species, scope', 'ev2', 'df2')} SELECT species::BIGINT AS species, scope, {_ROW_OUT} FROM r LEFT JOIN d USING (species, scope)")
def metric_by_era(spark, sf_dir):
    """Row-level scores overall and by era, in one pass."""
    frame, daily = frames(spark, sf_dir)
    return a.written(a.rounded(scoring.row_level(scoring.scoped(frame), scoring.scoped(daily), ("species", "scope")), *_ROW_COLUMNS))


_EVENT = """k AS (SELECT df.species, obs >= threshold AS o, pred >= threshold AS p, persistence >= threshold AS b, persistence IS NOT NULL AS known FROM df JOIN thr USING (species, doy) WHERE threshold > 0),
m AS (SELECT species, count(*) FILTER (WHERE o AND p) AS hits, count(*) FILTER (WHERE o AND NOT p) AS misses, count(*) FILTER (WHERE NOT o AND p) AS fa, count(*) FILTER (WHERE NOT o AND NOT p) AS cn, count(*) AS n, avg(o::INT) AS rate,
  count(*) FILTER (WHERE known AND o AND b) / nullif(count(*) FILTER (WHERE known AND (o OR b)), 0) AS csi_b FROM k GROUP BY species)"""


@query(f"""{_E}, {_EVENT}, q AS (SELECT *, hits / nullif(hits + misses + fa, 0) AS csi FROM m)
SELECT species::BIGINT AS species, hits::BIGINT AS event_hits, misses::BIGINT AS event_misses, fa::BIGINT AS event_false_alarms, cn::BIGINT AS event_correct_negatives, round(csi, 6) AS event_csi, round(hits / nullif(hits + misses, 0), 6) AS event_pod, round(fa / nullif(hits + fa, 0), 6) AS event_far,
n::BIGINT AS event_n_days, round(rate, 6) AS event_base_rate, round(csi_b, 6) AS event_csi_persistence, round({_HIGHER.format(s="csi", r="csi_b")}, 6) AS event_csi_skill_persistence FROM q""")
def metric_event(spark, sf_dir):
    _, daily = frames(spark, sf_dir)
    out = scoring.event_level(daily, a.thresholds(spark, sf_dir))
    return a.written(a.rounded(out, *[c for c, k in out.dtypes if k == "double"]))


_PROFILE = """pr0 AS (SELECT *, count(*) OVER (PARTITION BY species, date) AS k FROM ev), pr AS (SELECT species, date, hour, obs, pred FROM pr0 WHERE k >= 6),
cs AS (SELECT *, sum(obs) OVER o / nullif(sum(obs) OVER d, 0) AS co, sum(pred) OVER o / nullif(sum(pred) OVER d, 0) AS cp FROM pr WINDOW d AS (PARTITION BY species, date), o AS (PARTITION BY species, date ORDER BY hour ROWS UNBOUNDED PRECEDING)),
ds AS (SELECT species, date, sum(obs) AS birds, sum(abs(co - cp)) AS emd, arg_min(hour, [-obs, hour]) AS op, arg_min(hour, [-pred, hour]) AS pp FROM cs GROUP BY ALL HAVING sum(obs) > 0)"""


def profile(spark, sf_dir):
    hours = a.evaluation(spark, sf_dir).withColumn("row", F.col("hour")).withColumn("mask", F.lit(1.0)).withColumnRenamed("pred", "pred_hour")
    return scoring.profiles(hours)


@query(f"{_E}, {_PROFILE} SELECT species::BIGINT AS species, count(*)::BIGINT AS shape_n_days, round(avg(abs(op - pp)), 6) AS shape_peak_hour_mae, round(avg((abs(op - pp) <= 1)::INT), 6) AS shape_peak_hour_within_1h, round(avg(emd), 6) AS shape_emd FROM ds GROUP BY species")
def metric_shape(spark, sf_dir):
    out = scoring.shape_level(scoring.day_shapes(profile(spark, sf_dir)))
    return a.written(a.rounded(out, "shape_peak_hour_mae", "shape_peak_hour_within_1h", "shape_emd"))


@query(f"{_E}, {_PROFILE} SELECT species::BIGINT AS species, date::VARCHAR AS date, op::BIGINT AS obs_peak, pp::BIGINT AS pred_peak FROM ds")
def peak_pairs(spark, sf_dir):
    return a.written(scoring.day_shapes(profile(spark, sf_dir)).select("species", "date", "obs_peak", "pred_peak"))


def _passage_sql(v: str) -> str:
    levels = []
    for p in (10, 50, 90):
        x = p / 100
        under, over = f"max(CASE WHEN c_{v} <= {x} THEN doy END)", f"min(CASE WHEN c_{v} > {x} THEN doy END)"
        cu, co = f"max(CASE WHEN c_{v} <= {x} THEN c_{v} END)", f"min(CASE WHEN c_{v} > {x} THEN c_{v} END)"
        levels.append(f"CASE WHEN sum({v}) > 0 THEN CASE WHEN {under} IS NULL THEN {over} WHEN {over} IS NULL THEN {under} ELSE {under} + ({x} - {cu}) / ({co} - {cu}) * ({over} - {under}) END END AS {v}_p{p}_doy")
    return ", ".join(levels)


_SEASON = f"""cc AS (SELECT *, {", ".join(f"sum({v}) OVER (PARTITION BY species, year ORDER BY doy ROWS UNBOUNDED PRECEDING) / nullif(sum({v}) OVER (PARTITION BY species, year), 0) AS c_{v}" for v in ("obs", "pred"))} FROM df),
sy AS (SELECT species, year, count(*) AS n_days, CASE WHEN sum(obs) > 0 THEN sum(pred) / sum(obs) END AS total_ratio, {_passage_sql("obs")}, {_passage_sql("pred")} FROM cc GROUP BY species, year)"""
_DATES = [f"{v}_p{p}_doy" for v in ("obs", "pred") for p in (10, 50, 90)]


@query(f"{_E}, {_SEASON} SELECT species::BIGINT AS species, year::BIGINT AS year, n_days::BIGINT AS n_days, round(total_ratio, 6) AS total_ratio, {', '.join(f'round({c}, 4) AS {c}' for c in _DATES)}, round(pred_p50_doy - obs_p50_doy, 4) AS median_error_days FROM sy")
def metric_season_years(spark, sf_dir):
    _, daily = frames(spark, sf_dir)
    return a.written(a.rounded(a.rounded(scoring.season_years(daily), "total_ratio"), *_DATES, "median_error_days", digits=4))


@query(f"{_E}, {_SEASON} SELECT species::BIGINT AS species, count(*)::BIGINT AS season_n_years, round(avg(abs(pred_p50_doy - obs_p50_doy)), 4) AS season_median_date_mae, round(avg(total_ratio), 6) AS season_total_ratio FROM sy GROUP BY species")
def metric_season(spark, sf_dir):
    _, daily = frames(spark, sf_dir)
    return a.written(a.rounded(a.rounded(scoring.season_level(scoring.season_years(daily)), "season_total_ratio"), "season_median_date_mae", digits=4))


@query(f"{_E} SELECT species::BIGINT AS species, round({_SKILL.format(s='avg(abs(pred - obs))', r='avg(abs(phen - obs))')}, 6) AS skill FROM ev WHERE year % 3 = 1 GROUP BY species")
def metric_val_skill(spark, sf_dir):
    """Skill against the climatology on validation years alone."""
    ev = a.evaluation(spark, sf_dir).where(F.col("year") % 3 == 1)
    out = ev.groupBy("species").agg(scores.mae(F.col("obs"), F.col("pred")).alias("m"), scores.mae(F.col("obs"), F.col("phen")).alias("p"))
    return a.written(a.rounded(out.select("species", scores.skill(F.col("m"), F.col("p")).alias("skill")), "skill"))


@query(f"{_E} SELECT species::BIGINT AS species, round(1 - var_pop(obs - pred) / nullif(var_pop(obs), 0), 6) AS explained_variance, round(corr(obs, pred), 6) AS pearson, round(1 - sum((obs - pred) ^ 2) / nullif(var_pop(obs) * count(*), 0), 6) AS r_squared FROM ev GROUP BY species")
def explained_variance(spark, sf_dir):
    o, p = F.col("obs"), F.col("pred")
    r2 = 1 - F.try_divide(F.sum((o - p) * (o - p)), F.var_pop(o) * F.count("*"))
    out = a.evaluation(spark, sf_dir).groupBy("species").agg(scores.explained_variance(o, p).alias("explained_variance"), F.corr(o, p).alias("pearson"), r2.alias("r_squared"))
    return a.written(a.rounded(out, "explained_variance", "pearson", "r_squared"))


_RANK = "rank() OVER (PARTITION BY species ORDER BY {0}) + (count(*) OVER (PARTITION BY species, {0}) - 1) / 2.0"


@query(f"{_E}, d2 AS (SELECT species, round(obs, 6) AS obs, round(pred, 6) AS pred FROM df), rk AS (SELECT species, {_RANK.format('obs')} AS a, {_RANK.format('pred')} AS b FROM d2) SELECT species::BIGINT AS species, round(corr(a, b), 6) AS spearman FROM rk GROUP BY species")
def spearman(spark, sf_dir):
    _, daily = frames(spark, sf_dir)
    return a.written(a.rounded(scoring.spearman(a.rounded(daily, "obs", "pred"), "obs", "pred", ("species",)), "spearman"))


@query("""WITH x AS (SELECT (l_suppkey % 11)::INT AS species, l_orderkey % 3 AS seed, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
y AS (SELECT species, 'quantity' AS metric, quantity AS value FROM x UNION ALL SELECT species, 'price', price FROM x)
SELECT species::BIGINT AS species, metric, count(*)::BIGINT AS n_seeds, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, count(*) < 3 AS provisional FROM y GROUP BY ALL""")
def seed_summary(spark, sf_dir):
    x = a.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 11).alias("species"), (F.col("l_orderkey") % 3).alias("seed")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"))
    runs = x.select("species", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("quantity", "price")])))
    return a.rounded(scoring.seed_summary(runs), "mean", "std", digits=5)


_MU = "(pred + 1e-8)"


@query(f"{_E} SELECT species::BIGINT AS species, round(4.8 * avg(pow({_MU}, 0.4) / 0.4 - obs * pow({_MU}, -0.6) / -0.6), 4) AS loss FROM ev GROUP BY species")
def loss_tweedie(spark, sf_dir):
    out = a.evaluation(spark, sf_dir).groupBy("species").agg((4.8 * F.avg(scores.tweedie(F.col("obs"), F.col("pred"), 1.6))).alias("loss"))
    return a.written(a.rounded(out, "loss", digits=4))


_SPECIES = sorted(HYPERPARAMETERS)
_WEIGHTS = ", ".join(f"({i}, {HYPERPARAMETERS[n][2]!r}::DOUBLE, {HYPERPARAMETERS[n][3]!r}::DOUBLE)" for i, n in enumerate(_SPECIES))


@query(f"""{_E}, hy AS (SELECT * FROM (VALUES {_WEIGHTS}) AS t(species, weight, p))
SELECT species::BIGINT AS species, round(avg(weight * (pow({_MU}, 2 - p) / (2 - p) - obs * pow({_MU}, 1 - p) / (1 - p)) + 0.5 * (ln(1 + pred) - ln(1 + obs)) ^ 2 + 0.1 * ({_MU} - 1e-8 - obs * ln({_MU}))), 4) AS loss FROM ev JOIN hy USING (species) GROUP BY species""")
def loss_summed(spark, sf_dir):
    """A weighted sum of three loss terms, the first by each species' own weight and power."""
    hyper = training.hyperparameters(spark).withColumn("number", F.array_position(F.array(*map(F.lit, _SPECIES)), F.col("species")).cast("int") - 1).drop("species").withColumnRenamed("number", "species")
    rows = a.evaluation(spark, sf_dir).join(hyper, "species")
    loss = training.summed_loss(F.col("obs"), F.col("pred"), F.col("weight"), F.col("power"), {"tweedie": 1.0, "squared_log": 0.5, "poisson": 0.1})
    return a.written(a.rounded(rows.groupBy("species").agg(F.avg(loss).alias("loss")), "loss", digits=4))


@query(f"""WITH {a.HOURS} SELECT species::BIGINT AS species, date::VARCHAR AS date, hour::BIGINT AS hour, round(8 / (1 + exp(-((hour % 5) / 5.0::DOUBLE - 0.5 + (doy % 7) / 7.0::DOUBLE - 1))) * (count / (count + 50.0::DOUBLE)), 6) AS log_count FROM (SELECT species, date, doy, hour, sum(count) OVER (PARTITION BY species, date) AS count FROM hs)""")
def composed_log_counts(spark, sf_dir):
    """Hourly scores over a bias, damped by a share of the day."""
    days = a.hour_surveys(spark, sf_dir).groupBy("species", "date", "doy").agg(F.array_sort(F.collect_list("hour")).alias("hours"), F.sum("count").alias("count"))
    scores_of = F.transform("hours", lambda h: (h % 5) / F.lit(5.0) - 0.5)
    bias_of = F.transform("hours", lambda h: (F.col("doy") % 7) / F.lit(7.0) - 1)
    out = days.select("species", "date", F.inline(F.arrays_zip(F.col("hours").alias("hour"), scores.composed_log_count(scores_of, bias_of, F.col("count") / (F.col("count") + 50.0)).alias("log_count"))))
    return a.written(a.rounded(out, "log_count"))


@query(f"{_E} SELECT species::BIGINT AS species, round(sqrt(avg((ln(1 + pred) - ln(1 + obs)) ^ 2)), 6) AS log_rmse, round(sqrt(avg((pred - obs) ^ 2)), 6) AS rmse, round(sqrt(sum(pred ^ 2)), 4) AS l2 FROM ev GROUP BY species")
def loss_log_rmse(spark, sf_dir):
    o, p = F.col("obs"), F.col("pred")
    out = a.evaluation(spark, sf_dir).groupBy("species").agg(F.sqrt(F.avg(scores.squared_log_error(o, p))).alias("log_rmse"), F.sqrt(F.avg(scores.squared_error(o, p))).alias("rmse"), F.round(F.sqrt(F.sum(p * p)), 4).alias("l2"))
    return a.written(a.rounded(out, "log_rmse", "rmse"))


@query(f"{_E} SELECT species::BIGINT AS species, round(avg(pred - obs * ln({_MU})), 5) AS loss FROM ev GROUP BY species")
def loss_poisson(spark, sf_dir):
    return a.written(a.rounded(a.evaluation(spark, sf_dir).groupBy("species").agg(F.avg(scores.poisson_nll(F.col("obs"), F.col("pred"))).alias("loss")), "loss", digits=5))


@query(f"{_E}, x AS (SELECT species, date, lead(pred) OVER (PARTITION BY species, date ORDER BY hour) - pred AS d FROM ev) SELECT species::BIGINT AS species, round(sqrt(sum(d ^ 2)), 4) AS roughness FROM x GROUP BY species")
def loss_smoothness(spark, sf_dir):
    from pyspark.sql import Window as W

    step = F.lead("pred").over(W.partitionBy("species", "date").orderBy("hour")) - F.col("pred")
    out = a.evaluation(spark, sf_dir).withColumn("d", step).groupBy("species").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("roughness"))
    return a.written(a.rounded(out, "roughness", digits=4))


_SCALARS = f"{_E}, {_row_sql('species', 'ev', 'df')}, w AS (SELECT species, 'mae' AS metric, mae AS value FROM r UNION ALL SELECT species, 'bias', bias FROM r UNION ALL SELECT species, 'mae_persistence', mae_persistence FROM d)"


@query(f"{_SCALARS} SELECT species::BIGINT AS species, 'test/' || metric AS metric, round(value, 6) AS value FROM w WHERE value IS NOT NULL")
def report_scalars(spark, sf_dir):
    rows = scoring.row_level(*frames(spark, sf_dir))
    long = rows.select("species", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "bias", "mae_persistence")])))
    return a.written(a.rounded(scoring.finite_scalars(long), "value"))


@query(f"""{_E}, {_EV2}, s AS (SELECT species, scope, 'mae' AS metric, avg(abs(pred - obs)) AS v FROM ev2 GROUP BY ALL UNION ALL SELECT species, scope, 'bias', avg(pred - obs) FROM ev2 GROUP BY ALL)
SELECT species::BIGINT AS species, metric, round(max(v) FILTER (WHERE scope = 'overall'), 6) AS overall, round(max(v) FILTER (WHERE scope = 'early'), 6) AS early, round(max(v) FILTER (WHERE scope = 'middle'), 6) AS middle, round(max(v) FILTER (WHERE scope = 'late'), 6) AS late FROM s GROUP BY species, metric""")
def report_scopes(spark, sf_dir):
    """A table of metrics by scope for each species."""
    ev = scoring.scoped(a.evaluation(spark, sf_dir))
    s = ev.groupBy("species", "scope").agg(scores.mae(F.col("obs"), F.col("pred")).alias("mae"), scores.bias(F.col("obs"), F.col("pred")).alias("bias"))
    long = s.select("species", "scope", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "bias")])))
    return a.written(a.rounded(long.groupBy("species", "metric").pivot("scope", ["overall", *a.ERA_LABELS]).agg(F.max("value")), "overall", *a.ERA_LABELS))


@query(f"{_E} SELECT species::BIGINT AS species, date::VARCHAR AS date, round(obs, 6) AS obs, round(pred - obs, 6) AS residual FROM df")
def daily_residuals(spark, sf_dir):
    _, daily = frames(spark, sf_dir)
    return a.written(a.rounded(daily.select("species", "date", "obs", (F.col("pred") - F.col("obs")).alias("residual")), "obs", "residual"))


@query(f"{_E}, q AS (SELECT species, doy, quantile_cont(rate, 0.2) AS lower, quantile_cont(rate, 0.7) AS upper FROM dy GROUP BY ALL) SELECT df.species::BIGINT AS species, year::BIGINT AS year, df.doy::BIGINT AS doy, round(obs, 6) AS obs, round(pred, 6) AS pred, round(phen, 6) AS phen, round(lower, 6) AS lower, round(upper, 6) AS upper, round(threshold, 6) AS threshold FROM df JOIN q USING (species, doy) JOIN thr USING (species, doy)")
def season_curve(spark, sf_dir):
    """Each season's days with the climatology's mean, its band from level 20 to 70 and its event threshold."""
    _, daily = frames(spark, sf_dir)
    band = a.daily(spark, sf_dir).groupBy("species", "doy").agg(F.percentile("rate", F.array(F.lit(0.2), F.lit(0.7), F.lit(0.9))).alias("q"))
    out = daily.join(band, ["species", "doy"]).select("species", "year", "doy", "obs", "pred", "phen", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), F.col("q")[2].alias("threshold"))
    return a.written(a.rounded(out, "obs", "pred", "phen", "lower", "upper", "threshold"))


@query(f"{_E} SELECT species::BIGINT AS species, year::BIGINT AS year, doy::BIGINT AS doy, round(sum(obs) OVER (PARTITION BY species, year ORDER BY doy ROWS UNBOUNDED PRECEDING) / nullif(sum(obs) OVER (PARTITION BY species, year), 0), 6) AS share FROM df")
def cdf_season(spark, sf_dir):
    from pyspark.sql import Window as W

    _, daily = frames(spark, sf_dir)
    w = W.partitionBy("species", "year")
    share = F.try_divide(F.sum("obs").over(w.orderBy("doy").rowsBetween(W.unboundedPreceding, 0)), F.sum("obs").over(w))
    return a.written(a.rounded(daily.select("species", "year", "doy", share.alias("share")), "share"))


@query(f"{_E}, p AS (SELECT species, hour, obs / nullif(sum(obs) OVER (PARTITION BY species, date), 0) AS o, pred / nullif(sum(pred) OVER (PARTITION BY species, date), 0) AS p FROM ev) SELECT species::BIGINT AS species, hour::BIGINT AS hour, round(avg(o), 6) AS obs, round(avg(p), 6) AS pred FROM p GROUP BY species, hour")
def diurnal_shape(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("species", "date")
    part = lambda c: F.avg(F.try_divide(c, f"{c}_total")).alias(c)
    ev = a.evaluation(spark, sf_dir).withColumn("obs_total", F.sum("obs").over(w)).withColumn("pred_total", F.sum("pred").over(w))
    return a.written(a.rounded(ev.groupBy("species", "hour").agg(part("obs"), part("pred")), "obs", "pred"))


@query(f"""{_E}, o AS (SELECT species, date, avg(obs) AS m FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY m DESC, date) AS k FROM o),
z AS (SELECT *, row_number() OVER (PARTITION BY species ORDER BY (datediff('day', DATE '1970-01-01', date) * 7919) % 1009, date) AS j FROM r WHERE k > 4)
SELECT species::BIGINT AS species, date::VARCHAR AS date, 'busiest' AS tag FROM r WHERE k <= 4 UNION ALL SELECT species, date::VARCHAR, 'sampled' FROM z WHERE j <= 4""")
def sample_days(spark, sf_dir):
    """The four busiest days of each species and four of the rest, in an order fixed by the date."""
    from ..operators.explore import spread_of_days

    return a.written(spread_of_days(a.evaluation(spark, sf_dir), 8))
