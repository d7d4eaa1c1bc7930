"""The registered queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import new_path, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text of `documents`."""
    from .pii import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of `pages`."""
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one of `embeddings`, among all."""
    from .ann import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each of `documents` the mix by weights of sources takes."""
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each of `documents` begins and how long it is in token files written for this and read back."""
    from .token_files import read, write

    to = new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), to)
    return read(spark, to).withColumnRenamed("key", "doc_id")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of each of `documents` under links of like shingle sets."""
    from .ngram_join import shingle_components

    return shingle_components(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each of `embeddings` under links of like vectors of one label."""
    from .graph_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "embeddings"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all `documents` in packed sequences."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each of `documents`, learnt from those that are not held out."""
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of each of `documents`, learnt from `labels` that are not held out."""
    from .quality import grade

    return grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for white space, over all of `documents`."""
    from .exact_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings` on the leading whitened components."""
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, for each source of `documents`."""
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mix_sources": OP4, "op11_exact_dedup": OP11, "op13_filter_audit": OP13}


OP4 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('1:' || doc_id::VARCHAR || ':' || md5(coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / w AS level FROM r),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY level, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY level, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share FROM c),
k AS (SELECT (SELECT share FROM l WHERE share <= level ORDER BY level, n LIMIT 1) AS common),
t AS (SELECT source, n, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, w * common) END AS target FROM l, k),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.n,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT doc_id, n, size, (pass * source_size + sent)::DOUBLE / target AS finish FROM o, (VALUES (0), (1), (2)) AS passes(pass) WHERE size > 0 AND target > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY finish, n ROWS UNBOUNDED PRECEDING) AS reached FROM p),
g AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM q WHERE reached - size::DOUBLE / 2 <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT o.doc_id, o.size, o.source_size, o.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM o LEFT JOIN g ON o.doc_id = g.doc_id
"""

OP11 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY n_chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
        first_value(n_chars) OVER (PARTITION BY content ORDER BY n_chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS longest,
        count(*) OVER (PARTITION BY content) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n_chars = longest AS kept, sha256(content) AS text_sha256 FROM w
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)] AS fails
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
i AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS turns FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT turns, array_to_string(list_transform(turns, lambda t: substr('ABCDE', t, 1)), '') AS filter_order, i AS step, turns[i] AS own, turns[1:i - 1] AS before FROM o, i),
x AS (SELECT part, filter_order, step, n, good, toxic, fails[own] AS failed, coalesce(list_bool_or(list_transform(before, lambda t: fails[t])), false) AS gone,
        len(list_filter(fails, lambda f: f)) AS failures FROM s, c)
SELECT part, filter_order, step::INTEGER AS step,
  coalesce(sum(n) FILTER (NOT failed AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failed AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (failed AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed AND failures = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (failed AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (failed AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(failures, 1))) FILTER (failed), 0)::BIGINT AS shapley
FROM x GROUP BY part, filter_order, step
"""
