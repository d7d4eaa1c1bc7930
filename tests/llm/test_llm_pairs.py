"""Neighbours, near duplicates and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing.llm import ann, common, graph_dedup, ngram_join, words
from tallywing.llm.components import components
from tallywing.llm.signature_tree import SignatureTree, linked, similar

ODD_VECTORS = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 8, 1), (9004, [float("nan")] + [1.0] * 7, 1), (9005, [None] + [1.0] * 7, 1), (9006, [1.0, 2.0], 1), (None, [1.0] * 8, 1), (9007, [float("inf")] + [1.0] * 7, 1)]


def groups(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(100)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame([*pairs, (5, 5), (None, 3)], "a long, b long")).collect()}
    want = groups(1102, pairs)
    assert got == {i: want[i] for p in pairs for i in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs(spark):
    """Hubs that are the largest, the smallest and an id in the middle of their links, two of them joined by a leaf."""
    pairs = [(2000, i) for i in range(600)] + [(3000, 3000 + i) for i in range(1, 500)] + [(4300, i) for i in range(4000, 4800)] + [(599, 4000)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 0 for i in [*range(600), 2000, *range(4000, 4800)]} | {i: 3000 for i in range(3000, 3500)}
    assert got == want


def near_copies(rng, n=400, dim=8, labels=2):
    x = rng.normal(size=(n, dim))
    x[50:90] = x[0] + rng.normal(scale=0.02, size=(40, dim))
    x[100:110] = x[1]
    x[200] = x[2] * 3
    return x.astype(np.float32), rng.integers(0, labels, n)


def test_neighbours_equal_brute_force(spark):
    x, _ = near_copies(np.random.default_rng(3))
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(i, v) for i, v, _ in ODD_VECTORS]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"tree": F.lit(1), "score": F.lit(2)})
    got = ann.neighbours(df, 10, 20).toPandas()
    y = x.astype(np.float64)
    for q in range(0, 400, 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        order = np.lexsort((np.arange(400), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == order.tolist() and own.score.tolist() == pytest.approx(d[order].tolist())
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.where("vec_id < 4"), 10, 1).count() == 4 * 3


def test_forest_recall(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.neighbours(e).toPandas()
    p = e.toPandas().sort_values("vec_id")
    x, ids = np.stack(list(p.embedding)).astype(float), p.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[np.searchsorted(ids, q)]) ** 2).sum(axis=1))
        d[np.searchsorted(ids, q)] = np.inf
        hits += len(set(got[got.query_id == q].vec_id) & set(ids[np.lexsort((ids, d))[:10]]))
        total += 10
    assert hits >= 0.9 * total


@pytest.mark.parametrize("shard", [4096, 64])
def test_near_vectors_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(graph_dedup, "SHARD_ROWS", shard)
    x, labels = near_copies(np.random.default_rng(5))
    rows = [(i, list(map(float, v)), int(g)) for i, (v, g) in enumerate(zip(x, labels, strict=True))] + [(9100, [1.0] * 8, None), *ODD_VECTORS]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"shard": F.lit(1), "cid": F.lit(2)})
    got = {r.vec_id: r for r in graph_dedup.deduplicate(df).collect()}
    y = x.astype(np.float64)
    norm = np.linalg.norm(y, axis=1)
    link = ((y @ y.T) / np.outer(norm, norm) >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(400, dtype=bool)
    want = groups(400, np.argwhere(link))
    assert [got[i].n_links for i in range(400)] == link.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(400)] == want and all(got[i].kept == (want[i] == i) for i in range(400))
    for i, _, _ in [(9100, 0, 0), *ODD_VECTORS]:
        assert got[i].n_links == 0 and got[i].component_id == i
    assert len(got) == 409 and graph_dedup.deduplicate(df.limit(0)).count() == 0


def test_prune_keeps_the_nearest_and_what_it_does_not_cover():
    near = np.array([[0.1, 0.11, 1.0]])
    among = np.array([[[0, 0.01, 1.05], [0.01, 0, 1.05], [1.05, 1.05, 0]]])
    assert graph_dedup.robust_prune(near, among).tolist() == [[True, False, True]]


def shingles(text):
    w = tuple((text or "").encode().lower().split())
    return {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()


def plain_components(texts):
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], groups(len(texts), pairs)


def variants(rng, n=160):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choice(vocabulary, 60).tolist()
    texts = []
    for i in range(n):
        if i % 3 == 0 or not texts:
            w = rng.choice(vocabulary, rng.integers(1, 120)).tolist() + (passage if i % 4 == 0 else [])
        else:
            w = texts[rng.integers(0, len(texts))].split()
            for _ in range(rng.integers(0, 6)):
                w[rng.integers(0, len(w))] = vocabulary[rng.integers(0, 400)]
        texts.append(" ".join(w))
    return texts + ["", None, " \n ", "One two", "one TWO", "a b c d e", "É b c d e", "é b c d e", "passage " * 3000]


@pytest.mark.parametrize("tree_rows, sample", [(1024, 20_000), (16, 40)])
def test_shingle_groups_equal_brute_force(spark, monkeypatch, tree_rows, sample):
    monkeypatch.setattr(ngram_join, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(ngram_join, "SAMPLE_DOCS", sample)
    texts = variants(np.random.default_rng(7))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"hash": F.lit(1), "p": F.lit(2), "key": F.lit(3), "grp": F.lit(4)})
    got = {r.doc_id: r for r in ngram_join.shingle_components(df.repartition(3)).collect()}
    sizes, want = plain_components(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want


def test_shingle_odd_tables(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "A B C D E F")], "doc_id long, text string")
    got = ngram_join.shingle_components(df).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 2, 0), (7, 2, 7), (7, 2, 7), (8, 2, 7)]
    assert ngram_join.shingle_components(df.limit(0)).count() == 0


def test_tree_leaves_no_pair_out():
    rng = np.random.default_rng(9)
    base = [np.unique(rng.integers(0, 2**63, rng.integers(3, 200)).astype(np.uint64)) for _ in range(40)]
    sets = base + [np.unique(np.r_[b[: max(1, int(len(b) * rng.uniform(0.7, 1)))], rng.integers(0, 2**63, 3).astype(np.uint64)]) for b in base]
    found = {(int(a), int(b)) for x, y in SignatureTree(sets).pairs(75) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(sets[i], sets[j], 75)}
    assert want <= found and want
    assert linked(sets, np.arange(len(sets)), 75).tolist() == groups(len(sets), want)


def test_words_as_plain_python():
    import pyarrow as pa

    texts = ["Hello  wORLD\x0bx", "", None, "É é", "\ta\n"]
    data, off = common.raw(pa.array(texts))
    hashes, word_off = words.word_hashes(data, off)
    plain = [w for t in texts for w in (t or "").encode().lower().split()]
    assert np.diff(word_off).tolist() == [3, 0, 0, 2, 1] and len(set(hashes.tolist())) == len(set(plain)) and len(hashes) == len(plain)


def test_sets_that_count_many_times_fill_tasks_of_their_own(spark, monkeypatch):
    """Long texts count by bytes: groups split as large ones do, and the components stay the same."""
    rng = random.Random(12)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(80):
        words = base[i % 4].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in ngram_join.shingle_components(df).collect()}
    monkeypatch.setattr(ngram_join, "CLASS_BYTES", 64)
    monkeypatch.setattr(ngram_join, "TREE_ROWS", 256)
    got = {r.doc_id: r.component_id for r in ngram_join.shingle_components(df).collect()}
    assert got == want and len(set(want.values())) == 4


def test_chance_shingles_make_no_large_groups(spark, monkeypatch):
    """A chain of texts of which each shares a third with the next one: all meet at some shingle, and none is similar."""
    monkeypatch.setattr(ngram_join, "TREE_ROWS", 16)
    monkeypatch.setattr(ngram_join, "_EDGE", np.uint64(0))  # prefixes by hash alone
    rng = random.Random(3)
    made = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    parts = [made(30) for _ in range(101)]
    texts = [" ".join(parts[i] + made(30) + parts[i + 1]) for i in range(100)]
    texts += [t + " one more word" for t in texts[:12]] + [" ".join(parts[40] + made(8)) + f" {i}" for i in range(30)]
    largest, checked = [], ngram_join._checked

    def seen(sets, kind, percent):
        largest.append(sets.groupBy("grp").count().agg(F.max("count")).first()[0])
        return checked(sets, kind, percent)

    monkeypatch.setattr(ngram_join, "_checked", seen)
    got = {r.doc_id: r.component_id for r in ngram_join.shingle_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)[1]
    assert largest[0] <= 30, "the chain itself would be 100 and more"


@pytest.mark.parametrize("percent", [50, 75])
@pytest.mark.parametrize("most_meet, few_meet", [(256, 8), (256, 2), (4, 2)])
def test_large_groups_lose_no_similar_pair(spark, monkeypatch, most_meet, few_meet, percent):
    """However many classes meet at a shingle, those that are similar stay in one group."""
    monkeypatch.setattr(ngram_join, "TREE_ROWS", 4)
    monkeypatch.setattr(ngram_join, "MOST_MEET", most_meet)
    monkeypatch.setattr(ngram_join, "FEW_MEET", few_meet)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, k, replace=False), rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)]) for k in np.r_[rng.integers(1, 30, 40), rng.integers(34, 41, 20)]]
    cells = [(i, int(x)) for i, s in enumerate(sets) for x in s.view(np.int64)]
    groups_ = spark.createDataFrame([(i, 0) for i in range(60)], "cid long, grp long")
    maps = spark.createDataFrame([(i, len(s), bytearray(ngram_join._bitmap(s))) for i, s in enumerate(sets)], "cid long, n long, bitmap binary")
    got = {r.cid: r.grp for r in ngram_join._parted(groups_, spark.createDataFrame(cells, "cid long, hash long"), maps, "long", percent).collect()}
    pairs = [(i, j) for i in range(60) for j in range(i) if similar(sets[i], sets[j], percent)]
    assert pairs and all(got[i] == got[j] for i, j in pairs)


def test_bitmaps_leave_no_similar_pair_out():
    rng = np.random.default_rng(13)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(1, 1500, 80)]
    sets = base + [np.unique(np.r_[b[: max(1, int(len(b) * rng.uniform(0.7, 1)))], rng.integers(0, 2**63, len(b) // 9).astype(np.uint64)]) for b in base]
    maps = ngram_join._Bitmaps([ngram_join._bitmap(s) for s in sets], np.array([len(s) for s in sets]))
    i, j = np.triu_indices(len(sets), 1)
    may = set(np.flatnonzero(maps.may_link(i, j, 75)).tolist())
    want = {k for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if similar(sets[a], sets[b], 75)}
    assert want <= may and len(want) > 20 and len(may) < 0.2 * len(i)


def test_what_was_shuffled_for_a_cut_goes(spark):
    import glob
    import time

    folders = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    out = common.cut(spark.range(20_000).repartition(4, "id").groupBy((F.col("id") % 7000).alias("k")).count())
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 7000 and spark.conf.get(common._CLEANUP, None) in (None, "false")


def test_rounds_hold_few_copies_of_a_vector(spark, monkeypatch):
    """However many blocks a label has, what is written or moved at once doesn't grow with their number; every pair of blocks meets once."""
    monkeypatch.setattr(graph_dedup, "SHARD_ROWS", 80)
    x, _ = near_copies(np.random.default_rng(6))
    df = spark.createDataFrame([(i, list(map(float, v)), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    held, cut = [], graph_dedup.cut

    def seen(rows):
        out = cut(rows)
        held.extend([out.count()] if "vector" in out.columns else [])
        return out

    monkeypatch.setattr(graph_dedup, "cut", seen)
    got = {r.vec_id: r for r in graph_dedup.deduplicate(df).collect()}
    y = x.astype(np.float64)
    norm = np.linalg.norm(y, axis=1)
    link = ((y @ y.T) / np.outer(norm, norm) >= 0.98) & ~np.eye(400, dtype=bool)
    assert held and max(held) <= 400 and [got[i].n_links for i in range(400)] == link.sum(axis=1).tolist()
    placed = spark.range(1200).select("id", F.lit(12).alias("blocks"), (F.col("id") % 12).cast("int").alias("block"))
    rounds = [graph_dedup._round(placed, d, t) for d in range(1, 12) for t in range(min(2, 12 - d))]
    assert max(r.count() for r in rounds) <= 1200
    met = [tuple(r) for x in rounds for r in x.select("low", "high").distinct().collect()]
    assert sorted(met) == [(i, j) for i in range(12) for j in range(i + 1, 12)]
