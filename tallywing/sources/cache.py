"""A Parquet cache of station hours by location, its planning by calendar blocks, and guarded reading."""

from __future__ import annotations

import datetime
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_YEAR = 1940
# Calls an hour that the free service allows, and what one weighted call covers.
CALLS_AN_HOUR, VARIABLES_A_CALL, DAYS_A_CALL = 5000, 10, 14
SETTLING_DAYS = 7
#: Beside a cache: what was asked for.
ASKED = "-asked"


class Backfill(NamedTuple):
    """Blocks of a location that were written, those that stay for another run, and the weight of the written ones' requests."""

    written: int
    waiting: int
    weight: float


def shared_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallywing-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there, for work that passes over them several times."""
    to = shared_folder(rows.sparkSession, name)
    rows.write.parquet(to)
    return rows.sparkSession.read.schema(rows.schema).parquet(to)


def with_keys(hours: DataFrame) -> DataFrame:
    """Adds year and doy, which exist so that filters on them reach the files."""
    return hours.withColumn("year", F.year("datetime").cast("smallint")).withColumn("doy", F.dayofyear("datetime").cast("smallint"))


def write(hours: DataFrame, to: str, mode: str = "append") -> None:
    """Hours (location, datetime, ...) as zstd Parquet by location, sorted by time inside each file."""
    rows = with_keys(hours).repartition("location", "year").sortWithinPartitions("location", "datetime")
    rows.write.mode(mode).option("compression", "zstd").partitionBy("location").parquet(to)


def load(spark: SparkSession, source: str, locations: Iterable[str], variables: Iterable[str], years: Iterable[int] | None = None, doy: tuple[int, int] | None = None, strict: bool = True) -> DataFrame:
    """location, datetime, year, doy and the variables of the cells asked for.

    An empty cache or a missing location is an error under `strict`; years without rows are warned of.
    """
    locations, variables = list(locations), list(variables)
    found = spark.read.parquet(source)
    if lacking := [v for v in variables if v not in found.columns]:
        raise ValueError(f"the cache lacks {lacking}")
    found = found.where(F.col("location").isin(locations))
    if strict:
        present = {r[0] for r in found.select("location").distinct().collect()}
        if missing := sorted(set(locations) - present):
            raise ValueError(f"the cache has no rows of {missing}")
    if years is not None:
        years = [int(y) for y in years]
        found = found.where(F.col("year").isin(years))
        if strict and (absent := sorted(set(years) - {r[0] for r in found.select("year").distinct().collect()})):
            warnings.warn(f"the cache has no rows of {absent}", stacklevel=2)
    if doy is not None:
        found = found.where(F.col("doy").between(*doy))
    return found.select("location", "datetime", "year", "doy", *variables)


def widened_doy(doy: tuple[int, int], lag_days: int) -> tuple[int, int]:
    """The days to read so that lags of the days asked for are known."""
    return max(1, doy[0] - lag_days), doy[1]


def default_end(today: datetime.date | None = None) -> datetime.date:
    return (today or datetime.date.today()) - datetime.timedelta(days=SETTLING_DAYS)


def chunks(start: datetime.date, end: datetime.date, years: int) -> list[tuple[datetime.date, datetime.date, int, bool]]:
    """(first day, last day, block year, whether complete) of the calendar blocks that meet start to end.

    Blocks are counted from a fixed year, never clipped at their start, and clipped at `end`.
    """
    if years < 1:
        raise ValueError("a block has a year at least")
    out = []
    block = EPOCH_YEAR + (start.year - EPOCH_YEAR) // years * years
    while datetime.date(block, 1, 1) <= end:
        last = datetime.date(block + years - 1, 12, 31)
        out.append((datetime.date(block, 1, 1), min(last, end), block, last <= end))
        block += years
    return out


def chunk_table(spark: SparkSession, start: datetime.date, end: datetime.date, years: int) -> DataFrame:
    """The same plan as a table, computed where it is used."""
    first = EPOCH_YEAR + (start.year - EPOCH_YEAR) // years * years
    blocks = spark.range(first, end.year + 1, years).select(F.col("id").alias("block_year"))
    last = F.make_date((F.col("block_year") + years - 1).cast("int"), F.lit(12), F.lit(31))
    lo = F.make_date(F.col("block_year").cast("int"), F.lit(1), F.lit(1))
    return blocks.select("block_year", lo.cast("string").alias("lo"), F.least(last, F.lit(end)).cast("string").alias("hi"), (last <= F.lit(end)).alias("complete"))


def outstanding(plan: DataFrame, cached: DataFrame) -> DataFrame:
    """Planned blocks (location, block_year, hi, complete) that the cache's newest hours (location, block_year, newest) don't reach.

    A complete block is done if it is there at all; the trailing one once it reaches its last day.
    """
    done = plan.join(cached, ["location", "block_year"]).where(F.col("complete") | (F.to_date("newest") >= F.to_date("hi"))).select("location", "block_year")
    return plan.join(done, ["location", "block_year"], "left_anti")


def newest_hours(cached: DataFrame, years: int) -> DataFrame:
    block = (F.floor((F.col("year") - EPOCH_YEAR) / years) * years + EPOCH_YEAR).cast("long")
    return cached.groupBy("location", block.alias("block_year")).agg(F.max("datetime").alias("newest"))


def write_blocks(hours: DataFrame, to: str, years: int) -> None:
    """Hours by location and calendar block; a block that is written again replaces what was there of it."""
    block = (F.floor((F.col("year") - EPOCH_YEAR) / years) * years + EPOCH_YEAR).cast("int")
    rows = with_keys(hours).withColumn("block_year", block).repartition("location", "block_year").sortWithinPartitions("location", "block_year", "datetime")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("location", "block_year").parquet(to)


def asked(spark: SparkSession, to: str, years: int) -> DataFrame | None:
    """location, block_year and newest, the last day that was asked for and written, of the cache's blocks; null if there is no cache.

    Where no record is kept of what was asked, as in caches of another hand, the newest hour counts.
    Only blocks that have rows are listed: a record does not stand for files that are gone.
    """
    try:
        stored = newest_hours(spark.read.parquet(to), years)
    except AnalysisException:
        return None
    try:
        record = spark.read.parquet(f"{to.rstrip('/')}{ASKED}").where(F.col("years") == years)
    except AnalysisException:
        return stored
    record = record.groupBy("location", "block_year").agg(F.max("hi").cast("timestamp").alias("asked"))
    return stored.join(record, ["location", "block_year"], "left").select("location", "block_year", F.greatest("newest", "asked").alias("newest"))


def backfill(spark: SparkSession, to: str, locations: Iterable[str], start: datetime.date, end: datetime.date, years: int, fetch: Callable[[list[str], str, str], DataFrame],
             weight: Callable[[str, str], float] | None = None, left: float = float("inf"), together: int | None = None, overwrite: bool = False) -> Backfill:
    """Fetches the planned blocks that the cache `to` lacks and writes each in place of what it had.

    fetch(locations, first day, last day) gives the hours (location, datetime, ...). A block that was
    asked for up to its last day is done, even if the source lacks that day; the trailing one is asked
    for again as `end` moves on, and never doubles. With `weight`, the weight of a location's request
    for these days, blocks that no longer fit into `left` stay for another run. Every group of
    `together` locations (all of them by default) is written before the next is asked for, so that an
    interrupted run resumes where it stopped. `overwrite` fetches what is there too.
    """
    places = spark.createDataFrame([(x,) for x in dict.fromkeys(locations)], "location string")
    plan = chunk_table(spark, start, end, years).crossJoin(F.broadcast(places))
    stored = None if overwrite else asked(spark, to, years)
    todo = plan if stored is None else outstanding(plan.withColumn("complete", F.lit(False)), stored)
    blocks: dict[tuple[str, str, int], list[str]] = {}
    total, waiting = 0.0, 0
    for r in todo.select("location", "lo", "hi", "block_year").orderBy("lo", "location").collect():  # a row for each location and block
        cost = weight(r["lo"], r["hi"]) if weight else 0.0
        if waiting or total + cost > left:
            waiting += 1
            continue
        total += cost
        blocks.setdefault((r["lo"], r["hi"], r["block_year"]), []).append(r["location"])
    written = 0
    for (lo, hi, block), every in blocks.items():
        step = together or len(every)
        for at in range(0, len(every), step):
            some = every[at : at + step]
            write_blocks(fetch(some, lo, hi), to, years)
            record = spark.createDataFrame([(x, block, years, datetime.date.fromisoformat(hi)) for x in some], "location string, block_year long, years int, hi date")
            record.coalesce(1).write.mode("append").parquet(f"{to.rstrip('/')}{ASKED}")
            written += len(some)
    return Backfill(written, waiting, total)


def call_weight(n_days: int, n_variables: int) -> float:
    return n_variables / VARIABLES_A_CALL * n_days / DAYS_A_CALL


def pace_seconds(heaviest: float) -> float:
    """Seconds to wait between calls of which the heaviest has this weight."""
    return 3600 * heaviest / CALLS_AN_HOUR
