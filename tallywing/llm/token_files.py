"""Token ids in files: tokenized documents, range-coded, in ascending order of document ids.

Documents are range-partitioned and sorted by id; each task codes chunks of whole documents. A chunk
is one row of a Parquet table in the shared folder: its place, its documents' ids and lengths, and
the coded ids. Spark's own writer commits the table, so a lost task is simply run again. Reading
checks every block's checksum.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, slices
from .range_coder import decode, encode
from .tokens import default_path, encoder

END = 1
#: Ids from which on a chunk is coded: blocks are coded in step, and many of them cost little more than few.
CHUNK_IDS = 3 << 20
#: Bytes of text tokenized at once, as many as a batch has: each call hashes all runs that are kept anew, so few large calls cost less than many small ones.
TOKENIZED_BYTES = 8 << 20


def _coder(path: str):
    def run(batches):
        from pyspark import TaskContext

        part, chunk = TaskContext.get().partitionId(), 0
        keys, coded, n = [], [], 0

        def whole() -> pa.RecordBatch:
            ids, lengths = np.concatenate([i for i, _ in coded]), np.concatenate([np.diff(off) for _, off in coded])
            coded.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(ids)], pa.int64()),
                    pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([encode(ids)], pa.binary()),
                ],
                ["part", "chunk", "n_ids", "keys", "lengths", "coded"],
            )

        for batch in batches:
            for some in slices(batch, "text", TOKENIZED_BYTES):
                coded.append(encoder(path).encode(some.column("text"), END))
                keys.append(some.column("key"))
                n += len(coded[-1][0])
                if n >= CHUNK_IDS:
                    yield whole()
                    keys, n, chunk = [], 0, chunk + 1
        if keys:
            yield whole()

    return run


def write(documents: DataFrame, to: str, path: str | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts, each with END after it, to the folder `to`.

    Null texts count as empty, null ids come first, rows that share an id follow each other in the
    order of a hash of their texts; very long texts are one document all the same. An empty table
    gives an empty folder. Other columns, whatever their names, are not read.
    """
    rows = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = bounded_batches(rows).withColumn("place", F.xxhash64("text"))  # rows of one id are dealt out too
    ordered = rows.repartitionByRange("key", "place").sortWithinPartitions("key", "place").drop("place")
    ordered.mapInArrow(_coder(path or default_path()), "part int, chunk int, n_ids long, keys array<long>, lengths array<long>, coded binary").write.parquet(to)


def read(spark: SparkSession, source: str) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document in the folder; start counts the ids of all documents before it.

    Documents that share an id, or have none, have a row each, in the order in which they were
    written; very long ones are one row. A folder of no documents gives no rows; a spoilt or cut
    chunk is an error.
    """
    rows = spark.read.parquet(source)
    chunks = rows.select("part", "chunk", "n_ids")
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inner = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = chunks.withColumn("inner", inner).join(before, "part").select("part", "chunk", (F.col("part_start") + F.col("inner")).alias("begin"))

    def decoded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch.column("coded")[i].as_py()).astype("<u4")
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                off = np.r_[0, np.cumsum(lengths)]
                if off[-1] != len(ids):
                    raise ValueError("a chunk's documents don't match its ids")
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("part")[i].as_py()), pa.int32()), pa.array(np.full(n, batch.column("chunk")[i].as_py()), pa.int32()),
                        pa.array(batch.column("keys")[i].as_py(), pa.int64()), pa.array(off[:-1]), pa.array(lengths),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.int64()),
                    ],
                    ["part", "chunk", "key", "at", "n_tokens", "ids_crc32"],
                )

    found = rows.select("part", "chunk", "keys", "lengths", "coded").mapInArrow(decoded, "part int, chunk int, key long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "chunk"]).select("key", (F.col("begin") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, source: str) -> DataFrame:
    """key and ids (array of int) of every document in the folder."""

    def decoded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = decode(batch.column("coded")[i].as_py())
                off = np.r_[0, np.cumsum(np.array(batch.column("lengths")[i].as_py(), np.int64))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("keys")[i].as_py(), pa.int64()), lists], ["key", "ids"])

    return spark.read.parquet(source).select("keys", "lengths", "coded").mapInArrow(decoded, "key long, ids array<int>")
