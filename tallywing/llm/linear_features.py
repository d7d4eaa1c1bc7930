"""Hashed byte n-grams of whole texts and a bounded, even sample of labelled rows, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import LOWER, WHITE

_FACTOR = np.array([0, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z and every white space as a space."""
    out = LOWER[data]
    out[WHITE[data]] = 32
    return out


def ngram_buckets(data: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The bucket of the byte n-gram that starts at each place; near the end it runs into zeros."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)]).astype(np.uint32)
    key = padded[: len(data)].copy()
    for k in range(1, width):
        key = (key << np.uint32(8)) | padded[k : k + len(data)]
    key = (key ^ (key >> np.uint32(15))) * _FACTOR[width]
    key = (key ^ (key >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return key >> np.uint32(32 - bits)


def inside_text(off: np.ndarray, width: int) -> np.ndarray:
    """Whether the n-gram that starts at each place ends in the same text."""
    ok = np.ones(off[-1], bool)
    for k in range(1, width):
        at = off[1:] - k
        ok[at[at >= off[:-1]]] = False
    return ok


def even_sample(df: DataFrame, label: str, key: Column, most: int) -> DataFrame:
    """At most `most` rows, about as many of each label as there are, chosen by a hash of `key`.

    One count of the labels sets a share of the hash range for each; the hard bound is the final
    limit, taken in hash order, so that reruns agree.
    """
    counts = df.groupBy(F.col(label).alias("label_")).agg(F.count("*").alias("n_"))
    labels = max(1, counts.count())
    place = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30))
    placed = df.withColumn("place_", place).join(counts, F.col(label) == F.col("label_"))
    return placed.where(F.col("place_") < F.least(F.lit(1.0), F.lit(most / labels * 0.9) / F.col("n_")) * (1 << 30)).orderBy("place_", key).limit(most).drop("place_", "label_", "n_")
