"""Operators and stages against plain Python versions, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallywing.llm import html_text, langid, mixing, pii, quality
from tallywing.llm.common import table
from tallywing.llm.linear_features import _FACTOR

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def bucket(gram: bytes, bits: int) -> int:
    key = np.uint32(int.from_bytes(gram, "big"))
    with np.errstate(over="ignore"):
        key = (key ^ (key >> np.uint32(15))) * _FACTOR[len(gram)]
        key = (key ^ (key >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return int(key >> np.uint32(32 - bits))


def folded(text: str) -> bytes:
    return bytes(32 if b in b"\x20\t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in text.encode())


def held_out(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_language_equals_plain_prediction(spark, small):
    docs = table(spark, small, "documents").limit(150).cache()
    model = langid.train(docs.where(~langid.held_out(5, 0)), F.col("doc_id"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        text, mine = r.text or "", got[r.doc_id]
        data = folded(text)
        grams = [bucket(data[i : i + w], langid.BITS) for w in langid.WIDTHS for i in range(len(data) - w + 1)]
        if not any(c.isalpha() for c in text):
            assert (mine.lang_pred, mine.score, mine.rejected) == ("und", 0.0, True)
            continue
        z = (sum((model.scores[g].astype(float) for g in grams), np.zeros(len(model.languages))) / max(1, len(grams)) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert mine.lang_pred == model.languages[int(p.argmax())] and abs(mine.score - p.max()) < 1e-4 and mine.rejected == (mine.score < model.least)
    for r in langid.identify(docs).collect():
        assert r.held_out == held_out(r.doc_id, 5, 0)


def test_language_learns_long_texts_whole(spark):
    rng = random.Random(2)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, words("abcdefgh" if i % 2 else "opqrstuv", 3000), "xx" if i % 2 else "yy") for i in range(40)] + [(1, words("abcdefgh", 5), "xx")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, F.col("doc_id"))
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows) and {(r.doc_id % 2, r.lang_pred) for r in got} == {(1, "xx"), (0, "yy")}


def test_quality_equals_plain_scores(spark, small):
    docs, labels = table(spark, small, "documents").limit(150).cache(), table(spark, small, "labels")
    known = labels.where(~langid.held_out(3, 1)).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    model = quality.train(docs.select(F.col("doc_id").alias("key"), "text"), known)
    got = {r.doc_id: r for r in quality.grade(docs, labels).collect()}
    for r in docs.collect():
        data = folded(r.text or "")
        found = {bucket(data[i : i + w], quality.BITS) for w in (1, 2, 3) for i in range(len(data) - w + 1)}
        import pyarrow as pa

        every = set(quality.indicators(pa.array([r.text], pa.string()))[0].tolist())
        assert found <= every
        score = 1 / (1 + np.exp(-np.clip(model.slope * (sum(model.weights[i] for i in every) + model.bias) + model.shift, -30, 30)))
        mine = got[r.doc_id]
        assert abs(mine.score - score) < 1e-9 and mine.predicted == int(score >= 0.5) and mine.held_out == held_out(r.doc_id, 3, 1)


def test_hinge_fit_reaches_its_minimum():
    rng = np.random.default_rng(4)
    x = [np.unique(rng.integers(0, 60, 12)) for _ in range(80)]
    sign = np.where([3 in f or 7 in f for f in x], 1.0, -1.0)
    scale = np.ones(1 << quality.BITS)
    w, bias = quality.dual_coordinate_descent(x, scale, sign, epochs=400)
    cost = np.where(sign > 0, len(x) / (sign > 0).sum(), len(x) / (sign < 0).sum()) / 2 * 0.1

    def objective(w, bias):
        return ((w[:60] ** 2).sum() + bias**2) / 2 + (cost * np.maximum(0, 1 - sign * np.array([w[f].sum() + bias for f in x]))).sum()

    best = objective(w, bias)
    for _ in range(300):  # no step in any direction is better
        v = np.zeros_like(w)
        v[:60] = rng.normal(0, rng.choice([1e-1, 1e-2, 1e-3]), 60)
        assert objective(w + v, bias + rng.normal(0, 1e-2)) >= best - 1e-4


def test_ids_with_both_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"bad junk {i}") for i in range(40)], "key long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 1 - i % 2) for i in range(0, 40, 3)], "key long, label int")
    clean = labels.where(F.col("key") % 3 != 0)
    a, b = quality.train(docs, labels), quality.train(docs, clean)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_personal_data_odd_rows(spark):
    rows = [(1, "555-123-4567 is my phone"), (2, "IBAN DE89 3704 0044 0532 0130 00 Bank"), (None, "a@b.co"), (None, "a@b.co"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "key": F.lit(2), "n_email": F.lit("x")})
    got = sorted(((r.doc_id or 0, r.spans, r.n_email) for r in pii.scan(df).collect()))
    assert got == [(0, "email:0:6", 1), (0, "email:0:6", 1), (1, "local_phone:0:12", 0), (2, "iban:5:32", 0), (3, "", 0), (4, "", 0)]
    near, far = pii.scan(spark.createDataFrame([(1, "mail a@b.co"), (2, "x a@b.co")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert near.least_score > far.least_score >= 0.5
    assert pii.scan(df.limit(0)).count() == 0


def test_many_spans_in_one_text(spark):
    text = "".join(f"x{i} a{i}@b{i}.com é 555-123-{i % 10000:04d} phone +4915112345{i % 1000:03d} " for i in range(12_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", pii.redacted(F.col("text")).alias("t")).collect()}
    assert got[1] == "".join(f"x{i} <EMAIL> é <LOCAL_PHONE> phone <PHONE> " for i in range(12_000)) and got[2] is None and got[3] == "none"


def test_names_of_parts_are_no_verdict():
    tree, long = html_text.grow(html_text.LABELLED), "word " * 80
    for page in (f'<div class="notice-of-motion"><p>{long}</p></div>', f'<div class="share-price"><p>{long}</p></div>', f'<p title="a hidden gem">{long}</p>', f'<div class="legal"><p>{long}</p></div>'):
        assert html_text.main_text(page, tree)[0] == long.strip(), page
    for page in (f"<p hidden>{long}</p>", f'<div class="cookie-notice">{long}</div>', f'<ol class="comment-list"><li>{long}</li></ol>', f'<p style="display: none">{long}</p>', '<div class="share-buttons">share this</div>'):
        assert html_text.main_text(page, tree)[0] == "", page


def plain_mix(rows):
    """rows: (doc_id, text, source), to how often each is taken."""
    size = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    capped = {}
    while True:
        rest, open_ = sum(total.values()) - sum(capped.values()), [s for s in sources if s not in capped]
        goal = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if goal[s] > 3 * total[s] + 1e-9]
        if not over:
            goal |= capped
            break
        capped |= {s: 3.0 * total[s] for s in over}
    runs = []
    for n, s in enumerate(sources):
        place = lambda i: hashlib.md5(f"1:{'?' if rows[i][0] is None else rows[i][0]}:{hashlib.md5((rows[i][1] or '').encode()).hexdigest()}".encode()).hexdigest()
        order, sent = sorted((i for i in range(len(rows)) if rows[i][2] == s and size[i]), key=place), 0
        for p in range(3):
            for i in order:
                sent += size[i]
                runs.append((sent / goal[s], n, i))
    times, reached = [0] * len(rows), 0
    for _, _, i in sorted(runs):
        reached += size[i]
        if reached - size[i] / 2 > sum(total.values()):
            break
        times[i] += 1
    return times


def test_mix_equals_plain_queueing(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, i, 7]), " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])) + f" t{i}", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(1000, None, "a"), (1001, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).withColumns({"size": F.lit(1), "times": F.lit(2), "row": F.lit(3), "place": F.lit(4), "n": F.lit(5)})
    want = plain_mix(rows)
    got = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(df).collect())
    assert got == sorted((str(d), len((t or "").split()), k * len((t or "").split())) for (d, t, _), k in zip(rows, want, strict=True))
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in mixed.collect()) == sorted((str(d), t) for (d, t, _), k in zip(rows, want, strict=True) for _ in range(k))
    assert mixing.mix(df.limit(0)).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_equal_plain_groups(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            words[rng.randrange(60)] = f"x{i}"
        rows.append((i // 2 if i < 30 else i, " ".join(words), "en", "a", 1))
    rows += [rows[3], rows[40], (None, rows[0][1], "en", "a", 1), (200, "", "en", "a", 1), (201, None, "en", "a", 1)]
    distinct = sorted({(d, t) for d, t, *_ in rows if d is not None and t}, key=str)
    sets = [shingles(t) for _, t in distinct]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    groups = {}
    for (d, t), r in zip(distinct, root, strict=True):
        groups.setdefault(r, []).append((d, t))
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCUMENTS), "").collect()
    odd = [(r.doc_id, r.text) for r in got if not r.text or r.doc_id is None]
    assert sorted(odd, key=str) == sorted([(None, rows[0][1]), (200, ""), (201, None)], key=str)
    kept = [(r.doc_id, r.text) for r in got if r.text and r.doc_id is not None]
    assert len(kept) == len(set(kept)) == len(groups)
    for members in groups.values():
        own = [k for k in kept if k in members]
        assert len(own) == 1 and own[0][0] == min(d for d, _ in members)


def test_equal_texts_under_two_labels_keep_the_fit_finite():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 1 << langid.BITS, n)).astype(np.uint16) for n in (3, 8, 1, 2000, 5)] * 2
    scores, bias = langid._fit([(b, np.full(len(b), 1 / len(b), np.float32)) for b in x], np.array([0, 1, 2, 0, 1, 1, 0, 0, 2, 2]), 3)
    assert np.isfinite(scores).all() and np.isfinite(bias).all() and np.abs(scores).max() < 100
