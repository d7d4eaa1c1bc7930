"""Dates, eras, surveys' hours and local times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def era_of(year: Column, edges: tuple[int, int], labels: tuple) -> Column:
    return F.when(year < edges[0], labels[0]).when(year < edges[1], labels[1]).when(year.isNotNull(), labels[2])


def year_used(year: Column, mode: str, edges: tuple[int, int], period_years: tuple[int, int, int]) -> Column:
    """The year a model is told: always the first stand-in year, the era's stand-in year, or the year itself."""
    if mode == "constant":
        return F.lit(period_years[0])
    if mode == "period":
        return era_of(year, edges, period_years)
    return year


def scaled_year(year: Column, period_years: tuple[int, int, int] = (2000, 2100, 2200)) -> Column:
    return (year - period_years[0]) / F.lit(float(period_years[1] - period_years[0]))


def scaled_doy(doy: Column) -> Column:
    return (doy - 183) / F.lit(366.0)


def in_season(date: Column, season: tuple[int, int]) -> Column:
    return F.dayofyear(date).between(*season)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def midpoint_hour(start: Column, end: Column) -> Column:
    s, e = (F.unix_micros(x.cast("timestamp")) for x in (start, end))
    return F.floor(F.pmod((s + e) / 2, F.lit(86_400_000_000)) / 3_600_000_000).cast("int")


def clock_hours(ts: Column) -> Column:
    """Hour of day with minutes as a fraction; seconds are left out."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def coverage_mask(start: Column, end: Column, exact: bool = False) -> Column:
    """An array of 24: the part of each hour that a survey from clock hour `start` to `end` has watched.

    The default follows the customary formula, which counts a survey inside one hour as longer than
    it is; `exact` measures the true overlap.
    """
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    def watched(h: int, s: Column, e: Column) -> Column:
        if exact:
            return F.greatest(F.lit(0.0), F.least(e, F.lit(h + 1.0)) - F.greatest(s, F.lit(float(h))))
        return F.least(clip(F.lit(h) - s + F.lit(1.0)), clip(e - F.lit(h)))

    # in a list of one, wherever Spark moves the mask, the clock hours of a row are worked out once and not for each of the 24
    once = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.transform(once, lambda t: F.array(*[watched(h, t["start"], t["end"]) for h in range(24)]))[0]


def local_to_utc(ts: Column, zone: str) -> Column:
    """The instant of a local wall time; null where the clocks show it twice, an error where they never do."""
    first = F.to_utc_timestamp(ts, zone)
    again = F.from_utc_timestamp(first + F.expr("INTERVAL 1 HOUR"), zone)
    never = F.from_utc_timestamp(first, zone) != ts
    return F.when(never, F.raise_error(F.concat(F.lit("no such local time: "), ts.cast("string")))).when(again == ts, F.lit(None)).otherwise(first)


def parsed_time(date: Column, text: Column) -> Column:
    """A timestamp of a date and a time of day written in one of the usual ways; null if blank or unreadable."""
    clean = F.nullif(F.trim(text), F.lit(""))
    when = F.coalesce(*[F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), clean), F.lit(f"yyyy-MM-dd {p}")) for p in ("HH:mm:ss", "HH:mm", "H:mm")])
    return F.when(clean.isNotNull(), when)
