"""Exact duplicates: documents whose texts are the same but for white space.

Groups form in three steps, each of which compares whole contents and not digests alone: every
task merges its own copies (Spark's partial aggregation), digests that many rows share are merged
in salted groups, and the winners of the salts are combined. A text is moved once, and the winners
of salted groups once more. What goes back to the rows is a digest, an id and a size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Rows from which on a digest is salted, digests that are salted at most (the largest; the others are merged without salt), and salts.
HOT_ROWS, MOST_HOT, SALTS = 4096, 1000, 64
_SHIFT, _TOP = 1 << 65, 1 << 63


def content(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def _place(n_chars: str = "n_chars", doc_id: str = "doc_id") -> Column:
    """Larger for more code points, then for a smaller id; a null id comes last."""
    return F.col(n_chars).cast("decimal(10,0)") * _number(_SHIFT) + F.coalesce(_number(_TOP) - F.col(doc_id).cast("decimal(19,0)"), _number(0))


def _id_of(place: Column) -> Column:
    low = place % _number(_SHIFT)
    return F.when(low != 0, (_number(_TOP) - low).cast("long"))


def _judged(rows: DataFrame) -> DataFrame:
    """Columns of the result from those of a row, `best` and `n` of its group; both null: a group of one."""
    alone = F.col("best").isNull()
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(_id_of(F.col("best"))).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (_place() == F.col("best"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def deduplicate(documents: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For each row doc_id, the id of the row of its group that stays, the group's size, whether it is that row, and the digest of its content.

    Of equal contents the row with the most code points stays, then the one with the smallest id. A
    null text counts as empty, and empty texts (or texts of white space) are copies of each other. A
    null id comes after all others; it is kept as null. Rows that repeat both id and length within a
    group are one document listed again: all count, and all are marked alike. Very long texts are
    compared whole. An empty table gives an empty one; other columns are not read.
    `digest` may be any function of the content, even one under which different contents meet.
    """
    rows = documents.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.length("text").alias("n_chars"), content(F.col("text")).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    ids = cut(rows.select("doc_id", "n_chars", "digest", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")))
    sizes = cut(ids.groupBy("digest").agg(F.count("*").alias("n")))
    hot = [r.digest for r in sizes.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "digest").limit(MOST_HOT).collect()]
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)

    salted = rows.withColumn("salt", F.when(is_hot, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(-1)).groupBy("digest", "content", "salt").agg(F.max(_place()).alias("best"), F.count("*").alias("n"))
    # What had no salt is complete: it goes on under a number of its own, its content stays behind.
    own = F.when(F.col("salt") < 0, F.monotonically_increasing_id())
    winners = salted.select("digest", own.alias("own"), F.when(F.col("salt") >= 0, F.col("content")).alias("content"), "best", "n").groupBy("digest", "own", "content").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    winners = cut(winners.select("digest", "best", "n"))

    collided = None
    if winners.count() != sizes.count():  # a digest of several contents
        collided = cut(winners.groupBy("digest").agg(F.count("*").alias("contents")).where(F.col("contents") > 1).select("digest"))
        ids, winners = ids.join(collided, "digest", "left_anti"), winners.join(collided, "digest", "left_anti")
    copies = winners.where(F.col("n") > 1).select("digest", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("salt"), "best", "n")
    found = _judged(ids.withColumn("salt", F.when(is_hot, F.col("salt")).otherwise(-1)).join(copies, ["digest", "salt"], "left"))
    if collided is None:
        return found
    again = rows.join(collided, "digest", "left_semi")
    groups = again.groupBy("digest", "content").agg(F.max(_place()).alias("best"), F.count("*").alias("n"))
    return found.unionByName(_judged(again.join(groups, ["digest", "content"])))
