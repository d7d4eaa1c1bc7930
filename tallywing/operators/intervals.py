"""Intervals: overlaps, expansion to hours, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Blocks of each level last four times as long as those below, from an hour on; the longest last 120 years.
LEVELS, HOUR_MICROS = 11, 3_600_000_000


def _size(level: int) -> int:
    return HOUR_MICROS * 4**level


def _placed(df: DataFrame) -> DataFrame:
    """df with from_ and to_ (micros of the first and the last moment) and level_, the lowest whose blocks are as long as the interval."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    df = df.withColumn("from_", micros(F.col("start"))).withColumn("to_", F.greatest(F.col("from_"), micros(F.col("end")) - 1))
    level = F.coalesce(*[F.when(F.col("to_") - F.col("from_") < _size(n), F.lit(n)) for n in range(LEVELS - 1)], F.when(F.col("to_").isNotNull(), F.lit(LEVELS - 1)))
    return df.withColumn("level_", level)


def _blocks(df: DataFrame, of: Column) -> DataFrame:
    """Each interval once for every block (block_level_, block_) of the levels `of` that it touches: two a level at most."""
    touched = F.flatten(F.transform(of, lambda n: F.transform(F.sequence(F.floor(F.col("from_") / _long(n)), F.floor(F.col("to_") / _long(n))), lambda b: F.struct(n.alias("block_level_"), b.alias("block_")))))
    return df.select("*", F.inline(touched))


def _long(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(_size(n)) for n in range(LEVELS)]), level + 1)


def _full_hours() -> Column:
    """The full hours from the one that holds the start to the end; null for an interval that ends before it starts."""
    hours = F.sequence(F.date_trunc("hour", "start"), F.col("end").cast("timestamp"), F.expr("INTERVAL 1 HOUR"))
    return F.when(F.col("end") >= F.col("start"), hours)


def _overlapping_keys(left: DataFrame, right: DataFrame, key: str, by: tuple[str, ...], unlike_itself: bool) -> DataFrame:
    """Keys of left that overlap something of right.

    The shorter interval of a pair touches a block of the longer one's level that the longer one
    touches too: one side stays in its own level, the other goes up through the levels that the first
    side has. So an interval makes two rows for each of LEVELS levels at most, however long it is.
    """
    a, b = _placed(left), _placed(right)
    levels = lambda df: sorted(r[0] for r in df.select("level_").where("level_ IS NOT NULL").distinct().collect())  # noqa: E731  LEVELS at most
    above = lambda some, least: F.filter(F.array(*[F.lit(n) for n in some]).cast("array<int>"), lambda n: n >= least)
    own = F.when(F.col("level_").isNotNull(), F.array("level_"))
    sides = [(_blocks(a, above(levels(b), F.col("level_"))), _blocks(b, own)), (_blocks(a, own), _blocks(b, above(levels(a), F.col("level_") + 1)))]

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("a"), y.alias("b")
        on = (F.col("a.block_level_") == F.col("b.block_level_")) & (F.col("a.block_") == F.col("b.block_")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start"))
        for c in by:
            on &= F.col(f"a.{c}") == F.col(f"b.{c}")
        if unlike_itself:
            on &= F.col(f"a.{key}") != F.col(f"b.{key}")
        return x.join(y, on, "left_semi").select(key)

    return met(*sides[0]).unionByName(met(*sides[1])).distinct()


def overlapping(left: DataFrame, right: DataFrame, key: str, by: tuple[str, ...] = (), unlike_itself: bool = False) -> DataFrame:
    """Rows of left whose interval overlaps one of right; touching ends don't. key names left's rows."""
    return left.join(_overlapping_keys(left, right, key, by, unlike_itself), key, "left_semi")


def apart(left: DataFrame, right: DataFrame, key: str, by: tuple[str, ...] = (), unlike_itself: bool = False) -> DataFrame:
    """Rows of left whose interval overlaps none of right."""
    return left.join(_overlapping_keys(left, right, key, by, unlike_itself), key, "left_anti")


def neighbours_overlap(df: DataFrame, by: tuple[str, ...], key: str) -> DataFrame:
    """Flags rows that overlap the row before or after them in order of start."""
    w = W.partitionBy(*by).orderBy("start", "end", key)
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    return df.withColumn("overlaps", F.coalesce(F.col("start") < before, F.lit(False)) | F.coalesce(F.col("end") > after, F.lit(False)))


def hourly(df: DataFrame) -> DataFrame:
    """Each interval cut at full hours; empty parts and intervals that end before they start go."""
    cut = df.withColumn("hour_", F.explode(_full_hours()))
    start = F.greatest(F.col("start").cast("timestamp"), F.col("hour_"))
    end = F.least(F.col("end").cast("timestamp"), F.col("hour_") + F.expr("INTERVAL 1 HOUR"))
    return cut.withColumn("part_start", start).withColumn("part_end", end).where(F.col("part_start") < F.col("part_end")).drop("hour_")


def sample_instants(df: DataFrame) -> DataFrame:
    """Each interval's start, the full hours inside it and its end, each once; none of one that ends before it starts."""
    inside = F.filter(_full_hours(), lambda h: h > F.col("start").cast("timestamp"))
    every = F.array_distinct(F.concat(F.array(F.col("start").cast("timestamp")), inside, F.array(F.col("end").cast("timestamp"))))
    return df.withColumn("instant", F.explode(every))


def clipped_hour(df: DataFrame, seen: str = "seen") -> DataFrame:
    """The hour that holds a sighting, clipped to its period; a sighting on a full hour opens the hour after it."""
    hour = F.date_trunc("hour", seen)
    return df.withColumn("hour_start", F.greatest(hour, F.col("start").cast("timestamp"))).withColumn("hour_end", F.least(hour + F.expr("INTERVAL 1 HOUR"), F.col("end").cast("timestamp")))
