"""What the corpus operators share: input tables, lineage cuts and slices of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = spark.conf.get("spark.tallywing.shared", None) or tempfile.mkdtemp(prefix="tallywing-")
        spark.conf.set("spark.tallywing.shared", named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder once and read from there by everything that follows.

    What was shuffled for it goes as soon as it is written, and not when the driver happens to collect its garbage.
    """
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # of a plan made under this setting
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Consecutive slices of a batch whose texts hold at most `most` bytes, or one row.

    Work arrays are several times a slice's size. What Arrow has freed by the end goes back to the
    system, since Python workers live on and share the executor's memory.
    """
    _, off = raw(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def bounded_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df, the batches that Python gets of it being bounded by bytes: rows of text differ in length a thousandfold."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, None)
    if now and now.rstrip("b").isdigit() and int(now.rstrip("b")) > most:
        conf.set(key, f"{most}b")
    return df


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and the n + 1 offsets in them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the rows of values between neighbouring offsets, 0 where there are none."""
    n = len(off) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full], axis=0)
    return out
