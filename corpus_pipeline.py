"""The corpus pipeline: language ID, near duplicates, personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of `documents`, and works on every
row that the stage before it has kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.llm import langid, mixing, ngram_join, packing, pii
from tallywing.llm.common import cut, new_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough confidence, lang being the predicted one.

    The model learns from the labelled rows of docs. A null text or one without a letter is
    rejected; without any labelled row, everything is. Repeated rows are judged alike and all stay or
    go, very long texts are read whole, and an empty table gives an empty one.
    """
    docs = _documents(docs)
    model = langid.train(docs, F.col("doc_id"))
    found = langid.label_rows(docs, model).where(~F.col("rejected"))
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"row.{c}").alias(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Rows that share doc_id and text become one; rows that share a doc_id and differ in text are
    documents of their own, ordered by a hash of their texts. Rows without a doc_id, null or empty
    texts stay. An empty table gives an empty one.
    """
    docs = _documents(docs)
    tagged = docs.where(F.col("doc_id").isNotNull()).withColumn("tag_", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()))
    repeated = tagged.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("tag_").alias("a"), F.max("tag_").alias("b")).where(F.col("n") > 1)
    repeated = cut(repeated.select("doc_id", (F.col("a") != F.col("b")).alias("differ")))
    n_repeated, differ = repeated.agg(F.count("*"), F.max("differ")).first()
    key = F.col("doc_id")
    if differ:
        above_zero = F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
        key = F.concat_ws(":", F.lpad(above_zero.cast("string"), 21, "0"), F.lpad(F.hex("tag_"), 16, "0"))
    tagged = tagged.withColumn("key_", key)
    groups = ngram_join.shingle_components(tagged.select("key_", "text"), key="key_")
    dropped = groups.where(F.col("component_id") != F.col("key_")).select("key_").distinct()
    kept = tagged.join(dropped, "key_", "left_anti")
    if n_repeated:
        ids = repeated.select("doc_id")
        kept = kept.join(ids, "doc_id", "left_anti").unionByName(kept.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "tag_"]))
    return _documents(kept).unionByName(docs.where(F.col("doc_id").isNull()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars counts the new text.

    Null texts stay null, with an n_chars of null; repeated rows are changed alike, very long texts
    are read whole, and an empty table gives an empty one.
    """
    docs = _documents(docs).withColumn("text", pii.redacted(F.col("text")))
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them; those without a word go.

    Every row is taken for itself, whatever its doc_id; a null source is a source of its own. A very
    long text is one document, taken whole. An empty table gives an empty one.
    """
    return mixing.mixed_rows(_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences.

    A null or empty text is its end id alone, repeated rows are packed each, a very long text is cut
    into as many pieces as it needs, and an empty table gives no pieces.
    """
    return packing.pack_documents(_documents(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]
#: Language, shingle and packing stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        to = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return STAGES[-1][1](spark, docs, sf_dir)
