"""Scores, losses and array measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skill(score: Column, reference: Column, lower_is_better: bool = True) -> Column:
    """How far a score betters a reference, 1 being perfect; null where either is unknown or nothing is left to better."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    if lower_is_better:
        return F.when(finite(score) & finite(reference) & (reference != 0), 1 - F.try_divide(score, reference))
    return F.when(finite(score) & finite(reference) & (reference != 1), F.try_divide(score - reference, 1 - reference))


def contingency(observed: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates of two event columns: hits, misses, false_alarms, correct_negatives, csi, pod, far."""
    count = lambda c: F.count_if(c).cast("long")
    hit, miss, false, none = count(observed & predicted), count(observed & ~predicted), count(~observed & predicted), count(~observed & ~predicted)
    return {
        "hits": hit, "misses": miss, "false_alarms": false, "correct_negatives": none,
        "csi": F.try_divide(hit, hit + miss + false), "pod": F.try_divide(hit, hit + miss), "far": F.try_divide(false, hit + false),
    }


def mae(observed: Column, predicted: Column) -> Column:
    return F.avg(F.abs(predicted - observed))


def bias(observed: Column, predicted: Column) -> Column:
    return F.avg(predicted - observed)


def explained_variance(observed: Column, predicted: Column) -> Column:
    return 1 - F.try_divide(F.var_pop(observed - predicted), F.var_pop(observed))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def masked_rate(log_hourly: Column, mask: Column) -> Column:
    """The mean hourly count over the watched part of the day, of log1p counts by hour; null where nothing is watched."""
    return F.try_divide(array_sum(F.zip_with(log_hourly, mask, lambda p, m: F.expm1(p) * m)), array_sum(mask))


def first_covered_hour(mask: Column) -> Column:
    return F.greatest(F.array_position(F.transform(mask, lambda m: m > 0), True) - 1, F.lit(0)).cast("int")


def tweedie(observed: Column, predicted: Column, power: float, epsilon: float = 1e-8) -> Column:
    """The Tweedie deviance of a row, up to a constant."""
    mu = predicted + F.lit(epsilon)
    return F.pow(mu, F.lit(2 - power)) / F.lit(2 - power) - observed * F.pow(mu, F.lit(1 - power)) / F.lit(1 - power)


def poisson_nll(observed: Column, predicted: Column, epsilon: float = 1e-8) -> Column:
    return predicted - observed * F.log(predicted + F.lit(epsilon))


def squared_log_error(observed: Column, predicted: Column) -> Column:
    return F.pow(F.log1p(predicted) - F.log1p(observed), 2.0)


def squared_error(observed: Column, predicted: Column) -> Column:
    return F.pow(predicted - observed, 2.0)


#: Loss terms by name; a sum of them is a loss.
LOSSES = {"poisson": poisson_nll, "squared_log": squared_log_error, "squared": squared_error}


def prior_logit_bias(shape: Column, peak: float = 0.5, epsilon: float = 1e-6) -> Column:
    """A day's shape (array of 24) as logits, its highest hour at `peak`."""
    top = F.greatest(F.array_max(shape), F.lit(epsilon))
    return F.transform(shape, lambda s: F.log(s / top * F.lit(peak) + F.lit(epsilon)) - F.log1p(-(s / top * F.lit(peak)) + F.lit(epsilon)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


# Fixed value: the largest logarithm of a count that a composition reaches.
MOST_LOG_COUNT = 8.0


def composed_log_count(hourly: Column, bias: Column, daily: Column) -> Column:
    """Logarithms of the counts of a day's hours: hourly scores (an array) over the shape's bias, damped by the day's share in 0 to 1."""
    return F.transform(F.zip_with(hourly, bias, lambda z, b: sigmoid(z + b)), lambda h: F.lit(MOST_LOG_COUNT) * h * daily)


def first_argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


#: Power transforms of counts by name.
POWERS = {"log1p": F.log1p, "sqrt": F.sqrt, "sqrt_tenth": lambda c: F.sqrt(c) / F.lit(10.0), "fourth_root": lambda c: F.pow(c, 0.25), "cube_root": lambda c: F.pow(c, 1 / 3)}


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    """How many deviations a value lies from the mean; null without any deviation."""
    return F.try_divide(value - mean, deviation)


def trial_features(count: Column, doy: Column, year: Column) -> dict[str, Column]:
    """A count, day of year and year as the first trial network took them."""
    return {"log_count": F.log10(count + F.lit(1.0)), "doy_share": doy / F.lit(365.0), "year_share": (year - 2000) / F.lit(100.0)}


def format_cell(value: Column) -> Column:
    """A number as a table shows it: whole numbers plain, others to 3 significant digits, null blank."""
    digits = F.when(value == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), 2 - F.floor(F.log10(F.abs(value))))).cast("int")
    text = F.when(digits == 0, F.format_string("%.0f", value)).when(digits == 1, F.format_string("%.1f", value)).when(digits == 2, F.format_string("%.2f", value)).otherwise(F.format_string("%.3g", value))
    return F.when(value.isNull() | F.isnan(value), F.lit("")).when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(text)
