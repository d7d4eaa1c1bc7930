"""Small files of a run (records, metrics, models) in any store that Spark reaches, through Spark's own file system."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

#: Characters that go to the store at once.
PART = 1 << 20


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a pattern with wildcards names, in order of name."""
    p, fs = _path(spark, pattern)
    found = fs.globStatus(p)
    return sorted(x.getPath().toString() for x in found) if found is not None else []


def put(spark: SparkSession, path: str, text: Iterable[str]) -> None:
    """Writes a file whole or not at all: under another name first, then in place of what is there."""
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    p, fs = _path(spark, made)
    try:
        stream, held, size = fs.create(p, True), [], 0
        try:
            for t in text:
                held.append(t)
                size += len(t)
                if size >= PART:
                    stream.write(bytearray("".join(held), "utf-8"))
                    held, size = [], 0
            stream.write(bytearray("".join(held), "utf-8"))
        finally:
            stream.close()
        to, _ = _path(spark, path)
        over = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(p), fs.makeQualified(to), options)
    finally:
        fs.delete(p, False)


def copy(spark: SparkSession, source: str, to: str) -> None:
    """Copies a file or a folder with all it holds, in place of files of the same name."""
    s, from_fs = _path(spark, source)
    t, to_fs = _path(spark, to)
    if to_fs.exists(t):
        to_fs.delete(t, True)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, s, to_fs, t, False, True, spark._jsc.hadoopConfiguration())
