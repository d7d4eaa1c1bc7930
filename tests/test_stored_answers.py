"""Answers kept for an hour, seasons and species of configuration files, hourly reads without double cells."""

import datetime
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tallywing.functions import scores
from tallywing.sources import cache, forecasts, records


def test_an_answer_is_used_again_within_its_age(tmp_path):
    now, asked = [1000.0], []

    def get():
        asked.append(now[0])
        return {"n": len(asked)}

    read = lambda key="u": forecasts.kept_answer(str(tmp_path / "a"), key, get, 3600, lambda: now[0])
    assert read() == read() == {"n": 1}
    now[0] += 3599
    assert read() == {"n": 1}
    now[0] += 1
    assert read() == {"n": 2} and read("other") == {"n": 3} and asked == [1000.0, 4600.0, 4600.0]
    assert len(os.listdir(tmp_path / "a")) == 2  # nothing half-written stays
    for name in os.listdir(tmp_path / "a"):
        (tmp_path / "a" / name).write_text("{")
    assert read() == {"n": 4}


def test_two_forecast_reads_make_one_request(tmp_path, monkeypatch):
    hourly = {"start": 0, "end": 7200, "interval": 3600, "temperature_2m": [1.0, 2.0]}
    calls = []
    monkeypatch.setattr(forecasts, "fetched", lambda url, *a, **k: calls.append(url) or {"hourly": hourly})
    options = {"service": "forecast", "locations": json.dumps({"Basel": [47.5, 7.6]}), "columns": '["temperature_2m"]', "answers": str(tmp_path)}
    for more, n in (({}, 1), ({}, 1), ({"mostage": "0"}, 2)):
        reader = forecasts._Reader(options | more)
        assert len(list(reader.read(reader.partitions()[0]))) == 2 and len(calls) == n
    archive = forecasts._Reader(options | {"service": "archive", "start": "1970-01-01", "end": "1970-01-01"})
    for _ in range(2):
        list(archive.read(archive.partitions()[0]))
    assert len(calls) == 4  # never for the archive


def test_species_and_seasons_of_experiments(tmp_path):
    for folder in ("experiment", "data"):
        (tmp_path / folder).mkdir()
    (tmp_path / "data" / "site.yaml").write_text("batch: 3\ndoy: [196, 335]\nlag: 7\n")
    (tmp_path / "data" / "short.yaml").write_text("doy:\n  - 200\n  - 210 # days\nother: 5\n")
    (tmp_path / "experiment" / "a.yaml").write_text('defaults:\n  - override /data: site\n\ndata :\n  species: "Red Kite"\n  # "another"\n')
    (tmp_path / "experiment" / "b.yaml").write_text("defaults:\n  - override /data: short\ndata:\n  species: Osprey\n")
    (tmp_path / "experiment" / "c.yaml").write_text("defaults:\n  - override /data: short\ndata:\n  species: 'Merlin'\n  doy: [1, 366]\n")
    assert [(e["species"], e["name"], e["season"]) for e in records.experiments(str(tmp_path))] == [("Red Kite", "a", (196, 335)), ("Osprey", "b", (200, 210)), ("Merlin", "c", (1, 366))]
    (tmp_path / "experiment" / "d.yaml").write_text("defaults:\n  - override /data: site\n")
    with pytest.raises(ValueError, match="names no species"):
        records.experiments(str(tmp_path))
    (tmp_path / "data" / "bad.yaml").write_text("doy: [300, 200]\n")
    with pytest.raises(ValueError, match="no season"):
        records.season_of_data(str(tmp_path / "data" / "bad.yaml"))


def test_hourly_reads_refuse_double_cells(spark, tmp_path):
    row = lambda h: ("Basel", datetime.datetime(2020, 7, 1, h), 1.0)
    for name, hours in (("once", [1, 2]), ("twice", [1, 2, 2])):
        cache.write(spark.createDataFrame([row(h) for h in hours], "location string, datetime timestamp, temperature_2m double"), str(tmp_path / name))
    assert forecasts.weather(spark, "Basel", "temperature_2m", cache_dir=str(tmp_path / "once")).count() == 2
    with pytest.raises(ValueError, match="twice"):
        forecasts.weather(spark, "Basel", "temperature_2m", cache_dir=str(tmp_path / "twice"))


def test_composed_counts(spark):
    row = spark.range(1).select(scores.composed_log_count(F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(-1.0), F.lit(0.5)), F.lit(0.25)).alias("c")).first()
    assert row.c == pytest.approx([8 / (1 + math.exp(1)) / 4, 8 / (1 + math.exp(-2.5)) / 4])
