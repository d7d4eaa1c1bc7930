"""Small files through Spark's file system: whole or not at all."""

import os

import pytest

from tallywing.sources import files


def test_files_are_put_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART", 8)
    path = f"file://{tmp_path}/a.txt"
    files.put(spark, path, ["x" * 5, "é" * 7, "", "z"])
    assert (tmp_path / "a.txt").read_text() == "x" * 5 + "é" * 7 + "z"
    files.put(spark, path, [])
    assert (tmp_path / "a.txt").read_text() == ""

    def breaks():
        yield "long enough to be sent"
        raise RuntimeError("stop")

    files.put(spark, path, ["kept"])
    with pytest.raises(RuntimeError, match="stop"):
        files.put(spark, path, breaks())
    assert (tmp_path / "a.txt").read_text() == "kept" and [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["a.txt"]
    assert files.exists(spark, path) and not files.exists(spark, path + "x")


def test_patterns_and_copies(spark, tmp_path):
    for n in ("b", "a"):
        files.put(spark, f"{tmp_path}/in/{n}.json", [n])
    found = files.matching(spark, f"{tmp_path}/in/*.json")
    assert [os.path.basename(p) for p in found] == ["a.json", "b.json"] and files.matching(spark, f"{tmp_path}/none/*") == []
    for _ in range(2):
        files.copy(spark, f"{tmp_path}/in", f"{tmp_path}/out")
        assert sorted(n for n in os.listdir(tmp_path / "out") if not n.startswith(".")) == ["a.json", "b.json"]
    assert (tmp_path / "out" / "a.json").read_text() == "a"
