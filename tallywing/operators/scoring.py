"""Forecast verification at row, event, shape and season level, overall and by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import array_sum, bias, contingency, first_covered_hour, mae, masked_rate, skill
from ..functions.time import era_of
from . import ordered, survey


def build_frame(surveys: DataFrame, predictions: DataFrame, climatology: DataFrame | None = None, edges: tuple[int, ...] = (1993, 2014), labels: tuple[str, ...] = ("pre-1993", "1993-2013", "2014+"), on: tuple[str, ...] = ("species", "row")) -> DataFrame:
    """One row a survey with obs, pred, coverage, start_hour, doy, year, era and, with a climatology, phen.

    surveys: species, row, date, obs (birds an hour) and mask, the watched part of each of 24 hours.
    predictions: by the columns `on`, pred_hourly, an array of 24 log1p birds an hour, which are
    taken back to birds before they are averaged over the watched hours. climatology: species, doy,
    phen. An array of another length is an error; a survey without prediction has no row.
    """
    sized = lambda c: F.when(F.size(c) == 24, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} has to have 24 values, not "), F.size(c).cast("string"))))
    rows = surveys.withColumn("mask", sized("mask")).join(predictions.select(*on, sized("pred_hourly").alias("pred_hourly")), list(on))
    rows = rows.withColumns({"coverage": array_sum(F.col("mask")), "pred": masked_rate(F.col("pred_hourly"), F.col("mask")), "start_hour": first_covered_hour(F.col("mask")), "doy": F.dayofyear("date"), "year": F.year("date")})
    rows = rows.withColumn("era", era_of(F.col("year"), edges, labels))
    return rows if climatology is None else rows.join(climatology.select("species", "doy", "phen"), ["species", "doy"], "left")


def watched_hours(frame: DataFrame) -> DataFrame:
    """One row for each survey of a frame and hour it has watched: mask and pred_hour, birds an hour."""
    each = F.posexplode(F.arrays_zip("mask", "pred_hourly")).alias("hour", "at_")
    rows = frame.select("species", "date", "era", "row", "obs", "coverage", each)
    return rows.where(F.col("at_.mask") > 0).select("species", "date", "era", "row", "hour", "obs", "coverage", F.col("at_.mask").alias("mask"), F.expm1(F.col("at_.pred_hourly")).alias("pred_hour"))


def evaluate(frame: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row for each species and scope (`overall` and each era) with the measures of all four levels.

    frame: as of build_frame, with phen; thresholds: species, doy, threshold. Measures that a scope
    has no days for are null.
    """
    by, daily = ("species", "scope"), scoped(survey.daily_frame(frame))
    shapes = scoped(day_shapes(profiles(watched_hours(frame), ("species", "date", "era")), ("species", "date", "era")))
    out = row_level(scoped(frame), daily, by)
    for level in (event_level(daily, thresholds, by), shape_level(shapes, by), season_level(season_years(daily, (*by, "year")), by)):
        out = out.join(level, list(by), "left")
    return out


def yearly_agreement(daily: DataFrame, by: tuple[str, ...] = ("species", "year")) -> DataFrame:
    """Pearson's correlation and R squared of the days of each year."""
    o, p = F.col("obs"), F.col("pred")
    return daily.groupBy(*by).agg(F.corr(o, p).alias("pearson"), (1 - F.try_divide(F.sum((o - p) * (o - p)), F.var_pop(o) * F.count("*"))).alias("r_squared"))


def scoped(df: DataFrame, scope: str = "era") -> DataFrame:
    """Each row under `overall` and under its own scope: one pass gives both, also where measures aren't additive."""
    return df.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col(scope))))


def row_level(frame: DataFrame, daily: DataFrame, by: tuple[str, ...] = ("species",)) -> DataFrame:
    rows = frame.groupBy(*by).agg(F.count("*").alias("n_rows"), mae(F.col("obs"), F.col("pred")).alias("mae"), bias(F.col("obs"), F.col("pred")).alias("bias"), mae(F.col("obs"), F.col("phen")).alias("mae_phen"))
    known = daily.where(F.col("persistence").isNotNull())
    days = known.groupBy(*by).agg(mae(F.col("obs"), F.col("persistence")).alias("mae_persistence"), mae(F.col("obs"), F.col("pred")).alias("mae_daily"))
    out = rows.join(days, list(by), "left")
    return out.withColumn("mae_skill_phen", skill(F.col("mae"), F.col("mae_phen"))).withColumn("mae_skill_persistence", skill(F.col("mae_daily"), F.col("mae_persistence")))


def event_level(daily: DataFrame, thresholds: DataFrame, by: tuple[str, ...] = ("species",), on: tuple[str, ...] = ("species", "doy")) -> DataFrame:
    """Days at or above the threshold of their day of year, where that is above 0, against the prediction and the day before."""
    days = daily.join(thresholds, list(on)).where(F.col("threshold") > 0)
    seen, told, before = (F.col(c) >= F.col("threshold") for c in ("obs", "pred", "persistence"))
    known = F.col("persistence").isNotNull()
    both = days.groupBy(*by).agg(
        *[v.alias(f"event_{k}") for k, v in contingency(seen, told).items()], F.count("*").alias("event_n_days"), F.avg(seen.cast("double")).alias("event_base_rate"),
        contingency(seen & known, before & known)["csi"].alias("event_csi_persistence"),
    )
    return both.withColumn("event_csi_skill_persistence", skill(F.col("event_csi"), F.col("event_csi_persistence"), lower_is_better=False))


def profiles(hours: DataFrame, by: tuple[str, ...] = ("species", "date"), least_rows: int = 6, most_span: float = 1.5) -> DataFrame:
    """Hour-by-hour observed and predicted rates of days made of enough short surveys.

    hours: one row per survey row and watched hour (row, hour, mask, obs, pred_hour, coverage).
    """
    w = W.partitionBy(*by)
    rows = F.size(F.collect_set("row").over(w))
    good = hours.withColumn("rows_", rows).withColumn("span_", F.max("coverage").over(w)).where((F.col("rows_") >= least_rows) & (F.col("span_") <= most_span))
    profile = good.groupBy(*by, "hour").agg(F.try_divide(F.sum(F.col("obs") * F.col("mask")), F.sum("mask")).alias("obs"), F.first("pred_hour").alias("pred"), F.sum("mask").alias("weight"))
    profile = profile.where(F.col("weight") > 0)
    return profile.withColumn("hours_", F.count("*").over(w)).where(F.col("hours_") >= least_rows).drop("hours_", "weight")


def day_shapes(profile: DataFrame, by: tuple[str, ...] = ("species", "date")) -> DataFrame:
    """Of each day with birds: the distance of the peak hours and the earth mover's distance of the two shapes."""
    day, ordered = W.partitionBy(*by), W.partitionBy(*by).orderBy("hour").rowsBetween(W.unboundedPreceding, 0)
    share = lambda c: F.try_divide(F.sum(c).over(ordered), F.sum(c).over(day))
    gaps = profile.withColumn("gap", F.abs(share("obs") - share("pred"))).groupBy(*by).agg(
        F.sum("obs").alias("birds"), F.sum("gap").alias("emd"),
        F.max_by("hour", F.struct("obs", -F.col("hour"))).alias("obs_peak"), F.max_by("hour", F.struct("pred", -F.col("hour"))).alias("pred_peak"),
    )
    return gaps.where(F.col("birds") > 0).withColumn("peak_error", F.abs(F.col("obs_peak") - F.col("pred_peak")))


def shape_level(shapes: DataFrame, by: tuple[str, ...] = ("species",)) -> DataFrame:
    e = F.col("peak_error")
    return shapes.groupBy(*by).agg(F.count("*").alias("shape_n_days"), F.avg(e).alias("shape_peak_hour_mae"), F.avg((e <= 1).cast("double")).alias("shape_peak_hour_within_1h"), F.avg("emd").alias("shape_emd"))


def passage(daily: DataFrame, value: str, by: tuple[str, ...] = ("species", "year"), levels: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """The interpolated days of year by which 10, 50 and 90 % of a season's total have passed; null without any."""
    ordered = W.partitionBy(*by).orderBy("doy").rowsBetween(W.unboundedPreceding, 0)
    cdf = daily.withColumn("cdf", F.try_divide(F.sum(value).over(ordered), F.sum(value).over(W.partitionBy(*by))))
    # the last day at or under a level and the first above it
    aggs = []
    for level in levels:
        x = F.lit(level / 100)
        under, over = F.col("cdf") <= x, F.col("cdf") > x
        aggs += [F.max(F.when(under, F.struct("doy", "cdf"))).alias(f"u{level}"), F.min(F.when(over, F.struct("doy", "cdf"))).alias(f"o{level}")]
    out = cdf.groupBy(*by).agg(*aggs, F.sum(value).alias("total"))
    for level in levels:
        u, o = F.col(f"u{level}"), F.col(f"o{level}")
        between = u["doy"] + (F.lit(level / 100) - u["cdf"]) / (o["cdf"] - u["cdf"]) * (o["doy"] - u["doy"])
        out = out.withColumn(f"{value}_p{level}_doy", F.when(F.col("total") > 0, F.when(u.isNull(), o["doy"].cast("double")).when(o.isNull(), u["doy"].cast("double")).otherwise(between)))
    return out.select(*by, *[f"{value}_p{x}_doy" for x in levels])


def season_years(daily: DataFrame, by: tuple[str, ...] = ("species", "year")) -> DataFrame:
    """Passage dates and totals of each season, observed and predicted."""
    totals = daily.groupBy(*by).agg(F.count("*").alias("n_days"), F.when(F.sum("obs") > 0, F.sum("pred") / F.sum("obs")).alias("total_ratio"))
    both = totals.join(passage(daily, "obs", by), list(by)).join(passage(daily, "pred", by), list(by))
    return both.withColumn("median_error_days", F.col("pred_p50_doy") - F.col("obs_p50_doy"))


def season_level(years: DataFrame, by: tuple[str, ...] = ("species",)) -> DataFrame:
    return years.groupBy(*by).agg(F.count("*").alias("season_n_years"), F.avg(F.abs("median_error_days")).alias("season_median_date_mae"), F.avg("total_ratio").alias("season_total_ratio"))


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """Rank correlation by group, ties at their mean rank, no group in one task."""
    return ordered.rank_correlation(df, x, y, by)


def seed_summary(runs: DataFrame, by: tuple[str, ...] = ("species", "metric")) -> DataFrame:
    """Mean and deviation of each metric over seeds; one seed has no deviation, fewer than three are provisional."""
    known = runs.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy(*by).agg(F.count("*").alias("n_seeds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).withColumn("provisional", F.col("n_seeds") < 3)


def finite_scalars(scalars: DataFrame, prefix: str = "test") -> DataFrame:
    """metric and value of those that are finite, named under a prefix."""
    v = F.col("value")
    return scalars.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).withColumn("metric", F.concat(F.lit(f"{prefix}/"), F.col("metric")))
