"""Requests within a service's limits, refusals inside ordinary answers, and backfills that resume."""

import datetime
import io
import json
import random
import threading
import urllib.error

import pytest
from pyspark.sql import functions as F

from tallywing.registry import VARIABLES, source_columns
from tallywing.sources import cache, forecasts, pacing

DAY = datetime.date


class Clock:
    """A clock that moves only when somebody sleeps."""

    def __init__(self, now=1_000_000.0):
        self.now = now

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def within(spent, limits):
    for seconds, most in limits:
        for t, _ in spent:
            assert sum(w for u, w in spent if t - seconds < u <= t) <= most + 1e-6


def test_ledger_waits_no_longer_than_it_must():
    clock = Clock()
    ledger = pacing.Ledger(((60, 10), (3600, 100)), clock)
    for _ in range(2):
        assert ledger.wait(5) == 0
        ledger.add(5)
        clock.sleep(10)
    assert ledger.wait(1) == 40 and ledger.wait(6) == 50 and ledger.left() == 90
    clock.sleep(40)
    assert ledger.wait(5) == 0
    with pytest.raises(ValueError, match="never fits"):
        ledger.wait(11)


def test_random_requests_of_four_threads_stay_within_all_limits():
    clock, rng = Clock(), random.Random(3)
    ledger = pacing.Ledger(clock=clock)
    weights = [rng.choice([1.4, 20.0, 182.0, 250.0]) for _ in range(160)]
    with pacing.Pacer(ledger, sleep=clock.sleep, most_wait=10**6) as pacer:

        def asking(some):
            for w in some:
                pacing.ask(pacer.address, w)

        threads = [threading.Thread(target=asking, args=(weights[i::4],)) for i in range(4)]
        [t.start() for t in threads]
        [t.join(60) for t in threads]
    given = list(ledger.spent)
    assert len(given) <= 160 and clock.now - 1_000_000 > 86_400  # more than a day allows
    within(given, pacing.LIMITS)


def test_a_caller_without_the_key_gets_nothing():
    ledger = pacing.Ledger()
    with pacing.Pacer(ledger) as pacer:
        host, port, _ = pacer.address.split(":")
        with pytest.raises(Exception):  # noqa: B017  the two sides refuse each other in one of several ways
            pacing.ask(f"{host}:{port}:wrong", 1)
        pacing.ask(pacer.address, 1)
    assert [w for _, w in ledger.spent] == [1]


def test_long_waits_are_refused():
    clock = Clock()
    with pacing.Pacer(pacing.Ledger(((86_400, 10),), clock), most_wait=3600, sleep=clock.sleep) as pacer:
        pacing.ask(pacer.address, 8)
        with pytest.raises(pacing.BudgetSpent):
            pacing.ask(pacer.address, 8)
        with pytest.raises(ValueError, match="never fits"):
            pacing.ask(pacer.address, 11)


LIMITED = json.dumps({"error": True, "reason": "Minutely API request limit exceeded. Please try again in one minute."}).encode()


def test_refusals_inside_ordinary_answers_are_waited_out():
    answers, waits, asked = [LIMITED, urllib.error.HTTPError("u", 400, "", None, io.BytesIO(LIMITED)), urllib.error.HTTPError("u", 429, "", None, None), b'{"hourly": {}}'], [], []

    def get(url, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert forecasts.fetched("u", 1, wait=waits.append, get=get, leave=lambda: asked.append(1)) == {"hourly": {}}
    assert waits == [90, 90, 90] and len(asked) == 4  # every try asks for leave
    with pytest.raises(forecasts.RateLimited, match="Minutely"):
        forecasts.fetched("u", 1, wait=waits.append, get=lambda *_: LIMITED)
    assert len(waits) == 3 + 5
    with pytest.raises(ValueError, match="no such variable"):
        forecasts.fetched("u", 1, wait=waits.append, get=lambda *_: json.dumps({"error": True, "reason": "no such variable"}))
    assert len(waits) == 3 + 5


def stored_answers(folder, locations, first, days):
    names = [v for v, spec in VARIABLES.items() if spec.archived]
    start = int(datetime.datetime(first.year, first.month, first.day, tzinfo=datetime.UTC).timestamp())
    n = 24 * days
    hourly = {"start": start, "end": start + 3600 * n, "interval": 3600} | {c: [float(i % 24) for i in range(n)] for c in source_columns(names)}
    folder.mkdir()
    for x in locations:
        (folder / f"{x}.json").write_text(json.dumps({"hourly": hourly}))
    return str(folder)


def test_paced_backfill_in_four_tasks(spark, tmp_path):
    """Blocks are asked for by four tasks at once, at a clock of the test's own; the next day goes on where the first ended."""
    places, clock = ["Basel", "Munich", "Dijon", "Berlin"], Clock()
    responses = stored_answers(tmp_path / "answers", places, DAY(2020, 1, 1), 1096)
    limits, to = ((60, 40.0), (3600, 80.0), (86_400, 305.0)), str(tmp_path / "cache")
    run = lambda end, **more: forecasts.fill_cache(spark, to, places, "2020-05-01", end, 1, limits=limits, clock=clock, sleep=clock.sleep, responses=responses, most_wait=4000, **more)
    first = run("2022-03-31")  # eight whole years of 36.6 and four quarters of 9
    assert first.written == 9 and first.waiting == 3 and 290 < first.weight <= 305
    log = spark.read.parquet(f"{to}-requests").collect()
    assert len(log) == 9 and len({r["at"] for r in log}) > 5
    within([(r["at"], r["weight"]) for r in log], limits)
    assert run("2022-03-31")[:2] == (0, 3)  # what the day still allows is too little
    clock.sleep(86_400)
    assert run("2022-03-31")[:2] == (3, 0) and run("2022-03-31")[:2] == (0, 0)
    within([(r["at"], r["weight"]) for r in spark.read.parquet(f"{to}-requests").collect()], limits)
    hours = cache.load(spark, to, places, ["temperature_2m"])
    assert hours.count() == 4 * 24 * (366 + 365 + 90) and hours.groupBy("location", "datetime").count().where("count > 1").count() == 0
    clock.sleep(86_400)
    assert run("2022-04-30")[:2] == (4, 0)  # the trailing block moves on, complete ones stay


def test_complete_blocks_are_not_asked_for_again(spark, tmp_path):
    """A source that lacks a block's last day is asked once; a block that was cut short is asked again."""
    asked, to = [], str(tmp_path / "cache")
    every = spark.range(0, 24 * 700).select(F.lit("a").alias("location"), F.timestamp_seconds(F.lit(1577836800) + F.col("id") * 3600).alias("datetime"), F.lit(1.0).alias("v"))

    def fetch(locations, lo, hi):
        asked.append((lo, hi))
        return every.where(F.to_date("datetime").between(lo, hi) & (F.to_date("datetime") != "2020-12-31"))

    assert cache.backfill(spark, to, ["a"], DAY(2020, 1, 1), DAY(2021, 6, 1), 1, fetch).written == 2
    assert cache.backfill(spark, to, ["a"], DAY(2020, 1, 1), DAY(2021, 6, 1), 1, fetch).written == 0
    assert cache.backfill(spark, to, ["a"], DAY(2020, 1, 1), DAY(2022, 1, 1), 1, fetch).written == 2
    assert asked[2:] == [("2021-01-01", "2021-12-31"), ("2022-01-01", "2022-01-01")]
    assert cache.backfill(spark, to, ["a"], DAY(2020, 1, 1), DAY(2020, 12, 31), 1, fetch, overwrite=True).written == 1
    assert cache.load(spark, to, ["a"], ["v"]).groupBy("datetime").count().where("count > 1").count() == 0


def test_a_failing_block_keeps_those_before_it(spark, tmp_path):
    to, calls = str(tmp_path / "cache"), []

    def fetch(locations, lo, hi):
        calls.append(lo)
        if lo >= "2021" and len(calls) < 3:
            raise forecasts.RateLimited("Daily API request limit exceeded.")
        return spark.range(0, 24).select(F.lit("a").alias("location"), F.timestamp_seconds(F.unix_timestamp(F.lit(f"{lo} 00:00:00")) + F.col("id") * 3600).alias("datetime"), F.lit(1.0).alias("v"))

    with pytest.raises(forecasts.RateLimited):
        cache.backfill(spark, to, ["a"], DAY(2020, 1, 1), DAY(2021, 12, 31), 1, fetch)
    assert cache.backfill(spark, to, ["a"], DAY(2020, 1, 1), DAY(2021, 12, 31), 1, fetch).written == 1 and calls == ["2020-01-01", "2021-01-01", "2021-01-01"]
