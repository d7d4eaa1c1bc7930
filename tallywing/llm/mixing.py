"""Mixing sources to target weights by weighted fair queueing.

Every document is shuffled within its source by a hash, and its virtual finish time is the words
its source has sent up to and including it, divided by the source's target. Repeats of a source
follow its first pass: the same order again, with the source's size added. All passes of all sources
are range-sorted by virtual finish time, and the order is cut where its words reach the budget.

Sums along an order are taken in two steps, over the sums of ranges and then inside a range, so that
no task sees a whole source or the whole order, however large. What is sorted are times and sizes;
the cut gives each source the last document that it sends in each pass, and documents are compared
with these few rows where they are, so that no text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
MOST_PASSES = 3
#: Documents that one hash range of a source holds on average, or the square root of the source's number if that is more.
RANGE_ROWS = 1000


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), passes: int = MOST_PASSES) -> DataFrame:
    """source, its number n, rows_n, source_size and target for a table of one row a source (source, rows_n, source_size).

    Weights repeat over the sources in order of code points, null last. A target never exceeds
    `passes` times its source's size; what is above is shared by weight among the others. Sources
    reach their limit in order of size / weight, so the shared level is the first that stays under
    the next source's limit.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("n_", F.row_number().over(by_name)).withColumn("w_", F.array(*[F.lit(float(w)) for w in weights])[(F.col("n_") - 1) % len(weights)])
    ranked = ranked.withColumn("cap_", passes * F.col("source_size").cast("double")).withColumn("level_", F.col("cap_") / F.col("w_"))
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("level_", "n_").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("all_", F.sum(F.col("source_size").cast("double")).over(whole))
        .withColumn("weights_", F.sum("w_").over(whole))
        .withColumn("spent_", F.coalesce(F.sum("cap_").over(before), F.lit(0.0)))
        .withColumn("used_", F.coalesce(F.sum("w_").over(before), F.lit(0.0)))
        .withColumn("share_", (F.col("all_") - F.col("spent_")) / (F.col("weights_") - F.col("used_")))
        .withColumn("common_", F.min(F.when(F.col("share_") <= F.col("level_"), F.struct("level_", "n_", "share_"))).over(whole)["share_"])
    )
    target = F.when(F.col("common_").isNull(), F.col("cap_")).otherwise(F.least(F.col("cap_"), F.col("w_") * F.col("common_")))
    return ranked.select("source", F.col("n_").alias("n"), "rows_n", "source_size", target.alias("target"))


def _places(documents: DataFrame, seed: int, key: str, text: str, size: Column, source: str) -> DataFrame:
    """The columns of documents as `row`, with source, size and the document's place in its source's order beside it."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("?")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    return documents.select(row.alias("row"), F.col(source).alias("source"), size.alias("size"), F.struct(shuffle.alias("hash"), size.alias("size")).alias("place"))


def _starts(rows: DataFrame, by: list[str], along: str, amount: str) -> DataFrame:
    """For each group and range the amounts of all ranges of the group before it, as `before`."""
    sums = rows.groupBy(*by, along).agg(F.sum(amount).alias("part"))
    back = W.partitionBy(*by).orderBy(along) if by else W.orderBy(along)
    return sums.withColumn("before", F.coalesce(F.sum("part").over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))


def _cut_of(runs: DataFrame, budget: int) -> tuple[float, int] | None:
    """Time and source number of the first run (time, n, size) that has less than half of its words within the budget, in global order.

    None if there is none. Runs are range-sorted; the running sum is taken over the ranges, then inside the one that the budget ends in.
    """
    ranged = cut(runs.repartitionByRange("time", "n").withColumn("range", F.spark_partition_id()))
    starts = _starts(ranged, [], "range", "size")
    # ranges in order: in the first that ends above the budget, or the next one if that ends just above it, lies the cut
    last = starts.where(F.col("before") + F.col("part") >= budget).orderBy("range").limit(2).collect()
    for r in last:
        inside = ranged.where(F.col("range") == r["range"])
        running = F.sum("size").over(W.orderBy("time", "n").rowsBetween(W.unboundedPreceding, 0))
        over = inside.withColumn("sent", running + r["before"]).where(F.col("sent") - F.col("size") / 2 > budget).orderBy("time", "n").limit(1).collect()
        if over:
            return over[0]["time"], over[0]["n"]
    return None


def marks(places: DataFrame) -> DataFrame:
    """source, source_size, target and the place of the last document taken in each pass, null if it takes none.

    places: source, size and place of every document, as `_places` gives them.
    """
    rows = cut(places.select("source", "size", "place"))
    shares = cut(targets(rows.groupBy("source").agg(F.count("*").alias("rows_n"), F.sum("size").alias("source_size"))))
    budget = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # an even hash range of the source: the first hex digits, as many ranges as its rows need
    digits = F.conv(F.substring("r.place.hash", 1, 7), 16, 10).cast("long")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("s.rows_n") / F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt(F.col("s.rows_n")))))
    placed = rows.where(F.col("size") > 0).alias("r").join(F.broadcast(shares.alias("s")) if _small(shares) else shares.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "s.n", "r.size", "r.place", "s.source_size", "s.target", F.floor(digits * ranges / (1 << 28)).alias("range")
    )
    starts = _starts(placed, ["n"], "range", "size").select("n", "range", "before")
    within = W.partitionBy("n", "range").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.join(starts, ["n", "range"]).withColumn("sent", F.col("before") + F.sum("size").over(within))
    placed = cut(placed.where(F.col("target") > 0).select("n", "size", "place", *[((p * F.col("source_size") + F.col("sent")) / F.col("target")).alias(f"time{p}") for p in range(MOST_PASSES)]))
    runs = placed.select("n", "size", F.explode(F.array(*[f"time{p}" for p in range(MOST_PASSES)])).alias("time"))
    end = _cut_of(runs, budget)

    def before_end(p: int) -> Column:
        time = F.col(f"time{p}")
        return F.lit(True) if end is None else (time < F.lit(end[0])) | ((time == F.lit(end[0])) & (F.col("n") < F.lit(end[1])))

    sent = placed.groupBy("n").agg(*[F.max(F.when(before_end(p), F.col("place"))).alias(f"last{p}") for p in range(MOST_PASSES)])
    return cut(shares.join(sent, "n", "left").select("source", "source_size", "target", *[f"last{p}" for p in range(MOST_PASSES)]))


def _times(places: DataFrame) -> DataFrame:
    """places with source_size, target and `times`, how often the mix takes the document."""
    last = marks(places)
    last = last.select(F.col("source").alias("source_"), "source_size", "target", *[f"last{p}" for p in range(MOST_PASSES)])
    joined = places.join(F.broadcast(last) if _small(last) else last, F.col("source").eqNullSafe(F.col("source_")))
    passes = [F.when((F.col("size") > 0) & (F.col("place") <= F.col(f"last{p}")), 1).otherwise(0) for p in range(MOST_PASSES)]
    return joined.withColumn("times", sum(passes[1:], passes[0]))


def mix(documents: DataFrame, seed: int = 1, key: str = "doc_id", text: str = "text", size: Column | None = None, source: str = "source") -> DataFrame:
    """key, size, source_size, target and taken for every row.

    taken counts the words that the mix takes of the row, repeats counted: 0 to MOST_PASSES times
    its size. Null texts and texts without words have size 0 and take 0; a null source is a source
    of its own, a null key a key. Rows that share a key are rows of their own, with their own place
    by their text; rows that share key and text too are taken alike. Very long texts are only
    counted and hashed. An empty table gives an empty result. Other columns, whatever their names,
    are not read. Reruns agree.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), (word_count(text) if size is None else size).alias("size"))
    slim = _places(rows, seed, "key", "text", F.col("size"), "source")
    slim = cut(slim.select(F.struct(F.col("row.key").alias("key")).alias("row"), "source", "size", "place"))
    return _times(slim).select(F.col("row.key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed_rows(documents: DataFrame, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every row of documents as often as `mix` takes it, with the columns of documents; texts stay where they are."""
    taken = _times(_places(documents, seed, key, text, word_count(text), source)).where(F.col("times") > 0)
    return taken.withColumn("pass_", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def _small(shares: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources has few enough rows to send to every task."""
    return shares.limit(most + 1).count() <= most
