"""Text quality: naive Bayes support vectors over hashed n-gram indicators.

Indicators are whether a text holds a byte 1-, 2- or 3-gram (lower-cased), and a pair or triple of
neighbouring word shapes. Each indicator is scaled by its class log-count ratio, and a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent. A fifth of the
sample is kept back to turn margins into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, raw, slices
from .langid import held_out
from .linear_features import even_sample, folded, inside_text, ngram_buckets
from .words import LOWER, mix, word_bounds, word_hashes

BITS = 16
TRAIN_ROWS = 6000


@dataclass
class Model:
    weights: np.ndarray  # (2**BITS,): ratio times hinge weight
    bias: float
    slope: float
    shift: float


def _shapes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small number for each word: kinds of its first and last two bytes, length class, repeats of the word before."""
    kind = np.full(256, 3, np.uint64)  # signs
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 0
    starts, ends, word_off = word_bounds(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), word_off
    words, _ = word_hashes(data, off)
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    sign = lambda at: np.where(kind[data[at]] == 3, LOWER[data[at]], kind[data[at]]).astype(np.uint64)
    length = np.minimum(ends - starts, 15).astype(np.uint64) // np.uint64(4)
    shape = sign(starts)
    for part in (sign(ends - 1), sign(np.maximum(ends - 2, starts)), sign(np.minimum(starts + 1, ends - 1)), length, same):
        shape = shape * np.uint64(257) + part
    return mix(shape), word_off


def indicators(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct buckets of its indicators."""
    data, off = raw(texts)
    shape, word_off = _shapes(data, off)
    low = folded(data)
    grams = [(ngram_buckets(low, w, BITS), inside_text(off, w)) for w in (1, 2, 3)]
    none = np.zeros(1, np.uint64)
    one = shape >> np.uint64(64 - BITS)
    two = mix(shape[:-1] + shape[1:] * np.uint64(3)) >> np.uint64(64 - BITS) if len(shape) > 1 else none[:0]
    flag, out = np.zeros(1 << BITS, bool), []
    for i in range(len(texts)):
        a, b = off[i], off[i + 1]
        for g, ok in grams:
            flag[g[a:b][ok[a:b]]] = True
        a, b = word_off[i], word_off[i + 1]
        flag[one[a:b]] = True
        flag[two[a : max(a, b - 1)]] = True
        found = np.flatnonzero(flag)
        flag[found] = False
        out.append(found)
    return out


def _training_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            found = [x.astype(np.uint16).tobytes() for x in indicators(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(found, pa.binary())], ["label", "found"])


def log_count_ratio(x: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)]
    for found, label in zip(x, y, strict=True):
        counts[label][found] += 1
    neg, pos = (c / c.sum() for c in counts)
    return np.log(pos / neg)


def dual_coordinate_descent(x: list[np.ndarray], scale: np.ndarray, sign: np.ndarray, cost: float = 0.1, epochs: int = 15, seed: int = 3) -> tuple[np.ndarray, float]:
    """Minimises the L2-regularised hinge loss; the bias is a further indicator that is always set."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(x))
    norm = np.array([(scale[f] ** 2).sum() + 1 for f in x])
    weight = np.where(sign > 0, len(x) / max(1, (sign > 0).sum()), len(x) / max(1, (sign < 0).sum())) / 2 * cost
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            f = x[i]
            s = scale[f]
            slope = sign[i] * (w[f] @ s + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0), weight[i])
            change = (new - alpha[i]) * sign[i]
            if change:
                w[f] += change * s
                bias += change
                alpha[i] = new
                most = max(most, abs(change))
        if most < 1e-4:
            break
    return w, bias


def train(documents: DataFrame, labels: DataFrame, text: str = "text", most: int = TRAIN_ROWS) -> Model:
    """Fits the model on the texts of at most `most` rows of labels (key, label 0 or 1); with one class only it answers with that.

    The chosen keys are few enough to be sent to every task, so no text is moved but theirs.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("key").isNotNull()).select("key", F.col("label").cast("int").alias("label"))
    # an id with both labels teaches nothing; rows that share an id count once, by the smallest text
    known = known.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where(F.col("label") == F.col("other")).drop("other")
    chosen = even_sample(known, "label", F.col("key"), most)
    rows = bounded_batches(documents).select("key", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "key")
    found = rows.groupBy("key", "label").agg(F.min("text").alias("text")).select("text", "label").mapInArrow(_training_rows, "label int, found binary").collect()
    found.sort(key=lambda r: (r["label"], r["found"]))
    x, y = [np.frombuffer(r["found"], np.uint16) for r in found], np.array([r["label"] for r in found], int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0, 0.0, 3.0 if y.sum() else -3.0 if len(y) else 0.0)
    held = np.arange(len(x)) % 5 == 2
    fit = np.flatnonzero(~held)
    ratio = log_count_ratio([x[i] for i in fit], y[fit])
    w, bias = dual_coordinate_descent([x[i] for i in fit], ratio, np.where(y[fit] == 1, 1.0, -1.0))
    weights = w * ratio
    margin = np.array([weights[f].sum() + bias for f in x])[held]
    slope, shift = 1.0, 0.0
    for _ in range(100):  # Newton steps for the logistic curve over held margins, lightly held to slope 1
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        err, curve = p - y[held], np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(err * margin).sum() + 0.1 * (slope - 1), err.sum() + 0.1 * shift])
        hess = np.array([[(curve * margin**2).sum() + 0.1, (curve * margin).sum()], [(curve * margin).sum(), curve.sum() + 0.1]])
        move = np.linalg.solve(hess, grad)
        slope, shift = slope - np.clip(move[0], -1, 1), shift - np.clip(move[1], -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return Model(weights, float(bias), float(max(slope, 1e-3)), float(shift))


def _scorer(model: Model):
    def score(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                margin = np.array([model.weights[f].sum() + model.bias for f in indicators(part.column("text"))])
                p = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(p, pa.float64())], ["key", "score"])

    return score


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row; a null text counts as empty, and an empty text gets the score of no indicator."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return bounded_batches(rows).mapInArrow(_scorer(model), f"key {df.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def grade(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, learnt from the labelled documents that aren't held out.

    Null and empty texts get the score of no indicator; very long texts are read whole; repeated
    rows get a row each; a null doc_id is not held out. An id labelled 0 and 1 teaches nothing.
    Without labels every score is 0.5. Other columns, whatever their names, are not read.
    """
    known = labels.where(~held_out(3, 1)).select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    model = train(documents.select(F.col("doc_id").alias("key"), "text"), known)
    return predict(documents, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
