"""Personal data, main text, language, quality and mixing, with odd rows and against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from comparing import duck, same
from pyspark.sql import functions as F

from tallywing.llm import html_text, langid, mixing, pii, quality, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = (
        ("email", EMAIL, lambda s: True),
        ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in tests for m in p.finditer(text or "") if ok(m.group())]


def odd_documents(spark):
    rows = [(1, None, "en", "a", 7), (2, "", None, None, None), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, " \n\t ", "en", "b", 4), (None, "a b c d e f", "en", "a", 1), (5, "123 !?", "fr", "b", 6), (6, "wörter und " * 3000, "de", None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("score", "key", "size", "kind", "row", "component_id", "p", "n")})


def test_spans_equal_plain_search(spark):
    rng = random.Random(2)
    letters = "a1@.%+- ()0529\n-xé😀,"
    whole = ["john@x.com", "4111 1111 1111 1111", "+1 (555) 123-4567", "1.2.3.4", "256.1.1.1", "001.002.003.004", "a@b.c%d@e.f"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(whole) + rng.choice(["", ". ", " x", "@"]) + rng.choice(whole) for _ in range(800)]
    texts += [None, "", "1.2.3.4 " * 3000, "+1" + " " * 20000 + "2", "x" * 100000, "1" * 50000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.scan(df).collect():
        found = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest(), texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in found) for n in ("email", "ip", "card", "phone")]


@pytest.mark.parametrize("text, spans", [
    ("account DE89 3704 0044 0532 0130 00 ok", "iban:8:35"), ("DE89 3704 0044 0532 0130 01", ""), ("call me: 555-123-4567", "local_phone:9:21"), ("part 555-123-4567", ""),
    ("SSN 123-45-6789", "ssn:4:15"), ("no 123-45-6789", ""), ("SSN 000-45-6789", ""),
])
def test_checks_and_context(spark, text, spans):
    assert pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans == spans


def test_redaction(spark):
    df = spark.createDataFrame([("a john@x.com b 1.2.3.4",), ("clean",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(pii.redacted(F.col("text"))).collect()] == ["a <EMAIL> b <IP>", "clean", None, ""]


def test_scan_stays_native(spark, small):
    plan = queries.op1_pii(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("regexp_extract_all") == len(pii.KINDS)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="form"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div id="cookie-notice">We use cookies</div>
<div class="content"><h2>Title &amp; more</h2><p>Long   text about<br>something <a href=y>linked</a> and <b>bo</b>ld that goes on for many words.</p><script>var x = "</p>";</script><!-- no --><ul><li>one item<li>second item</ul>
<form><label>Name</label><input></form><p>Final paragraph here.</p></div><div class="sidebar"><p>Related things to read</p></div><section id=comments><p>A reader said a lot of things here</p></section><footer>&copy; 2020</footer>"""


def test_main_text():
    tree = html_text.grow(html_text.LABELLED)
    want = ["Title & more", "Long text about something linked and bold that goes on for many words.", "one item", "second item", "Final paragraph here."]
    assert html_text.main_text(PAGE, tree)[0] == "\n\n".join(want)
    assert html_text.main_text("<nav>x y</nav><article><h1>A</h1><p>b</p><aside>c</aside></article><p>d</p>", tree)[0] == "A\n\nb"
    for odd in (None, "", "<", "<p", "<!-- open", "<script>x", "a < b", "</p></div>", "<a href='x"):
        assert isinstance(html_text.main_text(odd, tree)[0], str)


def test_tree_learns_its_table():
    tree = html_text.grow(html_text.LABELLED)
    assert np.mean([html_text.decide(tree, row[:-1]) == row[-1] for row in html_text.LABELLED]) > 0.95


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and [r.n_chars for r in got][2:] == [0, 0] and got[0].n_chars == len(got[0].text)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert got.count() == docs.count() and held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert got.where("rejected").count() <= 0.005 * docs.count()


def test_language_of_odd_rows(spark):
    df = odd_documents(spark)
    got = langid.identify(df).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    und = [r for r in got if r.lang_pred == "und"]
    assert {r.doc_id for r in und} >= {1, 2, 4, 5} and all(r.rejected and r.score == 0 for r in und)
    assert langid.identify(df.limit(0)).count() == 0


def test_quality_separates(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.grade(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    held = got.where("held_out").join(labels, "doc_id")
    assert held.where("predicted = quality").count() >= 0.93 * held.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_quality_of_odd_rows(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (6, 1), (5, 0), (2, None)], "doc_id long, quality int")
    assert quality.grade(df, labels).count() == 8
    assert quality.grade(df, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.grade(df.limit(0), labels).count() == 0


def test_coordinate_descent_finds_the_margin():
    x = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    w, bias = quality.dual_coordinate_descent(x, np.ones(1 << quality.BITS), np.array([1.0, -1.0, 1.0, -1.0]), cost=100, epochs=200)
    assert w[0] + bias >= 0.99 and w[1] + bias <= -0.99


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_equals_sql(spark, sf):
    same(queries.op4_mix_sources(spark, f"/root/testdata/{sf}"), duck(f"/root/testdata/{sf}"), queries.OP4)


def plain_targets(sizes, weights, passes=3):
    capped, total = {}, sum(sizes)
    while True:
        rest = total - sum(capped.values())
        open_ = [i for i in range(len(sizes)) if i not in capped]
        shared = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if shared[i] > passes * sizes[i] + 1e-9]
        if not over:
            return [capped.get(i, shared.get(i)) for i in range(len(sizes))]
        capped |= {i: passes * sizes[i] for i in over}


def test_targets_equal_plain_sharing(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 20):
        sizes = [rng.choice([1, 10, 100, 1000, 5000]) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02d}", 1, s) for i, s in enumerate(sizes)], "source string, rows_n long, source_size long")
        got = [r.target for r in mixing.targets(df).orderBy("source").collect()]
        assert got == pytest.approx(plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(n)]))


def test_mix_of_odd_rows(spark):
    df = odd_documents(spark)
    got = mixing.mix(df).collect()
    assert len(got) == 8 and all(r["size"] * 3 >= r.taken >= 0 for r in got)
    assert {r.doc_id: r["size"] for r in got}[1] == 0 and mixing.mix(df.limit(0)).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
