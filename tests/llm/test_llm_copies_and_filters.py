"""Exact duplicates, filter audit and whitening against plain Python versions and their SQL, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from comparing import duck, same
from pyspark.sql import functions as F

from tallywing.llm import exact_dedup, filter_audit, whitening
from tallywing.llm import queries as llm
from tallywing.llm.common import table

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = re.compile(r"[\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_filter_audit"])
def test_same_rows_as_sql(spark, small, name):
    same(llm.queries()[name](spark, small), duck(small), llm.oracle_sql()[name])


def odd_documents():
    rows = [
        (1, "a b", "x", "s", 3), (2, "ab", None, "s", 2), (3, " a  b\t", None, None, 9), (4, "a b", None, "", 3), (5, None, None, "s", None), (6, "", None, "s", 0), (7, " \n\x0b\x0c\r", None, None, 5),
        (8, "中文 \U0001f600", None, "t", 4), (9, "中文\U0001f600 ", None, "t", 4), (10, "A b", None, "t", 3), (None, "ab  ", None, "s", 4), (None, "zz", None, "s", 2), (None, "zz", None, "s", 2),
        (11, "only once #", None, "t", 11), (12, "w " * 30000, None, "t", 60000), (13, "w" * 30000, None, "t", 30000), (14, "RUN AWAY " * 150, None, "u", 1350), (15, "RUN AWAY " * 150, None, "u", 1350),
        (15, "again", None, "u", 5), (15, "again", None, "u", 5), (-4, "again", None, "v", 5), (16, " ".join(f"w{i}" for i in range(250)), None, "v", 1), (17, " ".join(f"w{i % 99}" for i in range(250)) + "|", None, "v", 1),
    ]
    return rows


def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[WHITE.sub("", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    found = []
    for r in rows:
        mine = groups[WHITE.sub("", r[1] or "")]
        best = min(mine, key=lambda m: m[:3])
        found.append((r[0], best[3], len(mine), r[0] == best[3] and -len(r[1] or "") == best[0]))
    return Counter(found)


@pytest.mark.parametrize("digits", [64, 1, 0])
def test_copies_equal_plain_groups(spark, monkeypatch, digits):
    """Whole contents decide, also where salted digests or those of other contents meet."""
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 3)
    rows = odd_documents() * 2
    df = spark.createDataFrame(rows, DOCUMENTS).withColumn("digest", F.lit(1)).withColumn("salt", F.lit("x")).withColumn("content", F.lit(2)).repartition(5)
    got = exact_dedup.deduplicate(df, lambda c: F.substring(F.sha2(c, 256), 1, digits)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == plain_groups(rows)
    if digits == 64:
        want = Counter((r[0], hashlib.sha256(WHITE.sub("", r[1] or "").encode()).hexdigest()) for r in rows)
        assert Counter((r.doc_id, r.text_sha256) for r in got) == want


def test_copies_of_extreme_ids_and_of_nothing(spark):
    ids = [2**63 - 1, -(2**63), 0, None, -1]
    got = exact_dedup.deduplicate(spark.createDataFrame([(i, "same") for i in ids], "doc_id long, text string")).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(-(2**63), 5)} and [r.doc_id for r in got if r.kept] == [-(2**63)]
    empty = exact_dedup.deduplicate(spark.createDataFrame([], DOCUMENTS))
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and not empty.count()


def test_hot_group_moves_few_texts(spark):
    """A third of all rows are one text: its rows meet before they are dealt out."""
    df = spark.range(0, 60_000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"))
    got = exact_dedup.deduplicate(df)
    assert got.where("kept").count() == 40_001 and got.where("group_size = 20000 and keep_id = 0").count() == 20_000


def plain_audit(rows, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= t == 1
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    parts = defaultdict(list)
    for r in rows:
        text = r[1] or ""
        words = [w for w in WHITE.split(text) if w]
        fails = {f for f, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text),
            r[0] is not None and r[0] > least[text],
        ), strict=True) if bad}
        parts[r[3] or ""].append((fails, int(good[r[0]]), int(toxic[r[0]])))
    found = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                early = sum(f in d[0] for d in docs) - len(gone)
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                found[part, "".join(order), step] = (len(left), len(gone), early, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                found[part, "".join(order), step] += (shapley[f],)
    return found


def test_audit_equals_plain_counts(spark, monkeypatch):
    rows = odd_documents() * 2
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1), (14, None, 1), (15, 1, 0), (15, 1, 0), (999, 1, 1), (16, 1, 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("part", F.lit(1)).withColumn("mask", F.lit("x")).withColumn("n", F.lit(0))
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))).collect()
    mine = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert mine == plain_audit(rows, labels) and len(got) == 600 * 5


def test_audit_of_nothing(spark):
    assert not filter_audit.audit(spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count()
    only = filter_audit.audit(spark.createDataFrame([(1, None, None, None, None)], DOCUMENTS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert only.count() == 600 and only.agg(F.sum("removed")).first()[0] == 120


def plain_whitening(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), np.int64)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def held_against(got, ids, vectors):
    n, deviation, white, explained = plain_whitening(vectors)
    rows = defaultdict(dict)
    for r in got:
        rows[r.vec_id][r.component] = r
    assert len(got) == len(ids) * white.shape[1]
    sign = None
    for i, vec_id in enumerate(ids):
        mine = [rows[vec_id][k] for k in range(1, white.shape[1] + 1)]
        assert {(r.n, r.deviation, r.deviation_text) for r in mine} == {(n, deviation[i], str(deviation[i]))}
        z = np.array([r.whitened for r in mine])
        sign = np.sign(z * white[i]) if sign is None else sign
        assert np.allclose(z * sign, white[i], atol=1e-6)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-6) and all(r.identity_error < 1e-8 for r in mine)


def test_whitening_equals_plain_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 20 * 7)  # several blocks a partition, and several levels of the tree
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(240, 20)) * np.linspace(3, 0.5, 20)).astype(np.float32)
    vectors[200:] = vectors[7]  # many copies count once
    ids = list(range(240))
    rows = [(i, v.tolist(), 1) for i, v in zip(ids, vectors, strict=True)]
    odd = [(900, None, 1), (901, [1.0] * 19 + [None], 1), (902, [float("nan")] * 20, 1), (903, [float("inf")] + [0.0] * 19, 1), (904, [1.0, 2.0], 1), (905, [], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n int").withColumn("x", F.lit(1)).repartition(9)
    held_against(whitening.whiten(df).collect(), ids, vectors)


def test_whitening_of_the_table(spark, small):
    e = table(spark, small, "embeddings")
    rows = e.orderBy("vec_id").collect()
    held_against(whitening.whiten(e).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_of_few_or_flat_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert not whitening.whiten(spark.createDataFrame([], schema)).count()
    assert not whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count()
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (None, [0.0, 5.0])], schema)).collect()
    assert [(r.component, r.explained, abs(round(r.whitened, 9)), r.n) for r in got] == [(1, 1.0, 1.0, 2)] * 3


def test_deviation_beyond_64_bits(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [1e9])], "vec_id long, embedding array<double>")).collect()
    assert [(r.deviation, r.deviation_text) for r in got] == [(None, str(64**2 * 10**18))] * 2 and got[0].identity_error < 1e-9
    got = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [1e300]), (3, [-1e300])], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 3 and got[0].n == 3 and got[0].identity_error < 1e-6
