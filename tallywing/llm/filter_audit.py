"""How filters interact: what each of five filters removes at each place of each of their orders.

Every document gets a mask of the filters it fails. The masks are counted in at most 32 cells a
part; all orders are then worked out from the cells, whatever the number of documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, r"[#$%&*|]"


def _failures() -> list[Column]:
    """Failure of A to D, from columns text and words."""
    long = lambda c: c.cast("long")
    n, distinct, capitals = long(F.size("words")), long(F.size(F.array_distinct("words"))), long(F.length(F.regexp_replace("text", "[^A-Z]+", "")))
    return [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * long(F.length("text")), F.col("text").rlike(SYMBOLS)]


def _steps() -> Column:
    """filter_order, step, before (mask of the filters before this step) and own (this step's bit) of all orders."""
    found = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            found.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'before', {before}, 'own', {1 << i})")
            before |= 1 << i
    return F.expr(f"array({', '.join(found)})")


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i for filter i), n, good and toxic: how many documents of a part fail just these filters.

    E compares whole texts by grouping on them; the group's smallest doc_id goes back to the rows by
    id and a hash of the text, which tells rows of one id apart.
    """
    docs = documents.select(F.coalesce("source", F.lit("")).alias("part"), "doc_id", text_or_empty().alias("text"))
    firsts = docs.where(F.col("doc_id").isNotNull()).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.xxhash64("text").alias("tag"), F.lit(True).alias("first"))
    masked = docs.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).select(
        "part", "doc_id", F.xxhash64("text").alias("tag"), sum((f.cast("int") * (1 << i) for i, f in enumerate(_failures())), F.lit(0)).alias("mask")
    )
    masked = masked.groupBy("part", "doc_id", "tag", "mask").agg(F.count("*").alias("rows"))  # repeated rows meet where they are
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    named = masked.where(F.col("doc_id").isNotNull()).join(firsts, ["doc_id", "tag"], "left").join(known, "doc_id", "left")
    copy = F.col("first").isNull().cast("int") * (1 << FILTERS.index("E"))
    named = named.select("part", (F.col("mask") + copy).alias("mask"), "rows", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unnamed = masked.where(F.col("doc_id").isNull()).select("part", "mask", "rows", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    n = F.col("rows")
    return named.unionByName(unnamed).groupBy("part", "mask").agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what is kept and removed there, and what else the step's filter does.

    A null text counts as empty, a null source as the part of the empty name. Rows of one doc_id are
    documents of their own; equal texts of one id are no copies of each other. A row without id is
    never a copy, nothing is a copy of it, and it has no labels. A document is good or toxic if any
    of its label rows says so. Very long texts are read whole. Without documents there are no parts
    and no rows; other columns are not read.
    """
    by_part = cells(documents, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    steps = by_part.select("part", "cells", F.inline(_steps()))
    before, own = F.col("before"), F.col("own")
    fails, early = (lambda c: c.mask.bitwiseAND(own) != 0), (lambda c: c.mask.bitwiseAND(before) != 0)
    # The share of all 120 orders in which a filter comes first among those that a document fails.
    orders = sum(1 for _ in permutations(FILTERS))
    turns = lambda c: F.lit(orders).cast("long") / F.bit_count(c.mask)
    zero = F.lit(0).cast("long")
    sums = {
        "kept": lambda c: F.when(~fails(c) & ~early(c), c.n), "removed": lambda c: F.when(fails(c) & ~early(c), c.n), "redundant": lambda c: F.when(fails(c) & early(c), c.n),
        "unique_fails": lambda c: F.when(c.mask == own, c.n), "good_lost": lambda c: F.when(fails(c) & ~early(c), c.good), "toxic_lost": lambda c: F.when(fails(c) & ~early(c), c.toxic),
        "shapley": lambda c: F.when(fails(c), (c.n * turns(c)).cast("long")),
    }
    total = lambda f: F.aggregate("cells", zero, lambda so_far, c: so_far + F.coalesce(f(c), zero))
    return steps.select("part", "filter_order", "step", *[total(f).alias(name) for name, f in sums.items()])
