"""Tokens, files, packing and the pipeline."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallywing.llm import packing, range_coder, token_files, tokens
from tallywing.llm.common import new_path

LETTERS = "abcXYZéÈÿßÀñ0123'!?.,-_`~^\"\\<|>&µª²´Σσİŭ\u0301字😀\x85\xa0\x1c\x00 \n\t'sTll\xad"


def test_ids_equal_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["<|endoftext|> hi", "", None, "don't WE'LL I'd", "a" * 500, "½é"]
    texts += [f"{rng.choice(['', 'x', 'É '])}<|endoftext|>{t}<|StartOfText|><|startoftext|>" for t in texts[:60] if t]
    e, fresh = tokens.Encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    for part in (texts[:300], texts[300:], texts):
        ids, off = e.encode(pa.array(part, pa.string()), 1)
        for i, t in enumerate(part):
            assert ids[off[i] : off[i + 1]].tolist() == [*fresh.encode(t or "", add_special_tokens=False).ids, 1], t


def test_other_rules_use_the_library(tmp_path):
    rules = json.load(open(tokens.default_path(), encoding="utf-8"))
    rules["normalizer"] = None
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    e, fresh = tokens.Encoder(str(path)), Tokenizer.from_file(str(path))
    assert not e.by_runs
    ids, off = e.encode(pa.array(["Upper lower", None, "x y"], pa.string()), 9)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*fresh.encode(t, add_special_tokens=False).ids, 9] for t in ("Upper lower", "", "x y")]


@pytest.mark.parametrize("block", [7, 256, 4096, None])
def test_coder_round_trip(block):
    rng = np.random.default_rng(1)
    for ids in ([], [5], [0, 49407] * 40, [65535] * 50, rng.integers(0, 65536, 3000), np.minimum(rng.zipf(1.3, 5000), 60000), [7, 8, 9] * 700):
        ids = np.array(ids, np.uint32)
        assert (range_coder.decode(range_coder.encode(ids, block)) == ids).all()


def test_coder_learns_and_checks():
    ids = np.tile(np.arange(100, dtype=np.uint32), 100)
    coded = range_coder.encode(ids)
    assert len(coded) < len(ids)
    many = np.random.default_rng(2).integers(0, 300, 20_000).astype(np.uint32)  # several segments
    assert (range_coder.decode(range_coder.encode(many, 4)) == many).all()
    broken = bytearray(coded)
    broken[len(coded) // 2] ^= 0x55
    with pytest.raises(ValueError):
        range_coder.decode(bytes(broken))


def documents(spark):
    rows = [(9, "nine words", "en", "a", 1), (1, None, "en", "a", 1), (2, "", "en", None, 1), (2, "again", None, "b", 1), (None, "no id", "fr", "b", 1), (5, "long text here " * 4000, "en", "a", 1), (7, "Hello, World!", "de", "a", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"part": F.lit(1), "key": F.lit(2), "start": F.lit(3)})


def plain_ids(text, end):
    t = tokens.encoder(tokens.default_path()).tokenizer
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_files_hold_all_ids_in_order(spark):
    df, to = documents(spark), new_path(spark, "t")
    token_files.write(df.repartition(3), to)
    got = sorted(token_files.read(spark, to).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == [None, 1, 2, 2, 5, 7, 9]
    want = [plain_ids(t, 1) for t in ("no id", None, "", "again", "long text here " * 4000, "Hello, World!", "nine words")]
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == [(sum(map(len, want[:i])), len(w), zlib.crc32(w.tobytes())) for i, w in enumerate(want)]
    assert {tuple(r.ids) for r in token_files.read_ids(spark, to).collect()} == {tuple(w.tolist()) for w in want}
    empty = new_path(spark, "t")
    token_files.write(df.limit(0), empty)
    assert token_files.read(spark, empty).count() == 0


def test_windows_are_full():
    rng = random.Random(3)
    for lengths in ([], [1], [4096], [4097, 1], [rng.choice([1, 3, 40, 600, 2000, 4095, 9000]) for _ in range(300)]):
        seen = {}
        for size, pieces in packing.pack(np.array(lengths, np.int64)):
            assert size & (size - 1) == 0 and size <= 4096 and sum(p[2] for p in pieces) == size
            for d, s, n in pieces:
                seen.setdefault(d, []).append((s, n))
        for d, n in enumerate(lengths):
            at = 0
            for s, k in sorted(seen[d]):
                assert s == at
                at += k
            assert at == n


def test_pieces(spark):
    df = documents(spark).where("doc_id != 2")
    got = packing.pack_documents(df).toPandas()
    for i, text in ((9, "nine words"), (1, None), (5, "long text here " * 4000), (7, "Hello, World!")):
        want, own = plain_ids(text, 2), got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(want) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.r_[0, np.cumsum(own.length)][:-1].tolist() and own.length.sum() <= 4096
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_step_groups_are_even():
    groups = packing._step_groups([4096] * 100 + [512] * 40 + [1])
    load = np.bincount(groups, weights=[4096] * 100 + [512] * 40 + [1])
    assert load.max() - load.min() <= 4096


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "pack"]
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        to = new_path(spark, name)
        stage(spark, docs, sf).write.parquet(to)
        docs = found[name] = spark.read.parquet(to)
        if name != "pack":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert found["language"].count() >= 0.99 * n
    assert found["near_duplicates"].count() <= found["language"].count() and found["near_duplicates"].select("doc_id").distinct().count() == found["near_duplicates"].count()
    assert found["personal_data"].where(F.col("text").rlike(r"[a-z]@[a-z0-9-]+\.[a-z]")).count() == 0
    assert found["pack"].select("doc_id").distinct().count() == found["mix"].select("doc_id").distinct().count()
    run = corpus_pipeline.run(spark, sf)
    assert run.agg(F.sum("length")).first()[0] == found["pack"].agg(F.sum("length")).first()[0]


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "a", 1), (2, "", "en", None, 1), (3, "some words here now yes", "en", "a", 1), (3, "some words here now yes", "en", "a", 1), (None, "no id but words", "fr", "b", 1), (4, "Some words here now yes", "de", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1))
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 1, 2, 3]
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").count()
        assert stage(spark, docs.limit(0), "").count() == 0
