"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its byte 3- and 4-grams (lower-cased A-Z, white
space as one byte), each hashed to one of 2**BITS rows. Embeddings and softmax are trained together
by stochastic gradient descent in numpy on a bounded sample of labelled rows. A tenth of the sample
is kept back to set the softmax's temperature and the confidence below which a prediction is
rejected. Since the vector is a mean and the softmax linear, a prediction only needs the mean of
one row of class scores per n-gram: embeddings times weights are multiplied out before use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, per_doc, raw, slices
from .linear_features import even_sample, folded, inside_text, ngram_buckets

BITS, WIDTHS, DIM = 15, (3, 4), 16
#: Rows that the training reads at most, over all languages; each has at most 2**BITS kinds of n-grams.
TRAIN_ROWS = 2000


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (2**BITS, languages): embedding times softmax weights
    bias: np.ndarray
    temperature: float
    least: float  # calibrated confidence under which a prediction is rejected


def _count_grams(batches):
    """Each labelled text as its distinct n-gram buckets and their shares."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, off = raw(part.column("text"))
            data, rows = folded(data), []
            grams = [(ngram_buckets(data, w, BITS), inside_text(off, w)) for w in WIDTHS]
            for i in range(part.num_rows):
                a, b = off[i], off[i + 1]
                h = np.concatenate([g[a:b][ok[a:b]] for g, ok in grams])
                bucket, n = np.unique(h, return_counts=True)
                rows.append((bucket.astype(np.uint16).tobytes(), (n / max(1, n.sum())).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "bucket", "share"])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = 6, least_steps: int = 300, rate: float = 40.0, seed: int = 7):
    """Class scores of each bucket and biases; few rows are gone through more often, to `least_steps` steps."""
    rng, epochs = np.random.default_rng(seed), max(epochs, -(-least_steps // max(1, len(x) // 16)))
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    weights, bias = np.zeros((n_classes, DIM), np.float32), np.zeros(n_classes, np.float32)
    weights += rng.normal(0, 0.1, weights.shape).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 16)):
            if not len(part):
                continue
            # text by text: long ones have very many n-grams
            v = np.stack([x[i][1] @ emb[x[i][0]] for i in part])
            p = _softmax(v @ weights.T + bias)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = p @ weights
            # steps are held to what a model of this size bears, so that short texts or equal texts under two labels can't make it run away
            size = (weights**2).sum()
            weights -= step / (1 + step * (v**2).sum(axis=1).mean()) * (p.T @ v)
            bias -= step / (1 + step) * p.sum(axis=0)
            for i, change in zip(part, back, strict=True):
                held = step / (1 + step * (x[i][1] ** 2).sum() * size)
                emb[x[i][0]] -= held * x[i][1][:, None] * change
    return emb @ weights.T, bias


def train(labelled: DataFrame, key: Column, text: str = "text", label: str = "lang", most: int = TRAIN_ROWS) -> Model:
    """Fits the model on at most `most` rows of `labelled` that have a text and a label.

    Without any such row the model knows no language, and everything is rejected.
    """
    rows = bounded_batches(labelled).where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label"), key.alias("key"))
    chosen = even_sample(rows.select("label", "key"), "label", F.col("key"), most)
    # rows that share an id and a label count once, by the smallest text, so that what is collected keeps its bound
    some = rows.join(F.broadcast(chosen.distinct()), ["key", "label"], "left_semi").groupBy("key", "label").agg(F.min("text").alias("text"))
    found = some.select("text", "label").mapInArrow(_count_grams, "label string, bucket binary, share binary").collect()
    found.sort(key=lambda r: (r["label"], r["bucket"], r["share"]))
    languages = sorted({r["label"] for r in found})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    x = [(np.frombuffer(r["bucket"], np.uint16), np.frombuffer(r["share"], np.float32)) for r in found]
    y = np.array([languages.index(r["label"]) for r in found])
    held = np.arange(len(x)) % 10 == 3
    held &= held.sum() >= 20
    fit = np.flatnonzero(~held)
    scores, bias = _fit([x[i] for i in fit], y[fit], len(languages))
    temperature, least = 1.0, 0.0
    if held.any():
        z = np.stack([(scores[x[i][0]] * x[i][1][:, None]).sum(axis=0) + bias for i in np.flatnonzero(held)])
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(z)), y[held]] + 1e-9).mean() for t in np.geomspace(0.01, 5, 61)}
        temperature = min(loss, key=loss.get)
        p = _softmax(z / temperature)
        right = p.argmax(axis=1) == y[held]
        # a rejected text is nearer to chance than to the least sure text of the held part that was right
        chance = 1 / len(languages)
        sure = float(p.max(axis=1)[right].min()) if right.any() else chance
        least = chance + (sure - chance) / 2
    del found, x
    give_back()
    return Model(languages, scores.astype(np.float32), bias.astype(np.float32), float(temperature), least)


def _predictor(model: Model):
    def predict(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = raw(part.column("text"))
                data = folded(data)
                total, n = np.zeros((part.num_rows, len(model.languages)), np.float64), np.zeros(part.num_rows)
                for w in WIDTHS:
                    ok = inside_text(off, w)
                    grams = model.scores[ngram_buckets(data, w, BITS)]
                    grams *= ok[:, None]
                    total += per_doc(grams, off)
                    n += np.maximum(0, np.diff(off) - w + 1)
                letters = np.asarray(part.column("letters").to_numpy(zero_copy_only=False), bool)
                if model.languages:
                    p = _softmax((total / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                else:
                    best, score, letters = np.zeros(len(n), int), np.zeros(len(n)), letters & False
                lang = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(lang, pa.string()), pa.array(score), pa.array(~letters | (score < model.least))], ["key", "lang_pred", "score", "rejected"]
                )

    return predict


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score and rejected for every row of df; no column other than the text is read.

    A null text or one without a letter is `und` with score 0, and rejected. Other texts get one of
    the model's languages; rejected says that the calibrated confidence is too low to rely on.
    Repeated rows get a row each.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = df.schema[key].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(_predictor(model), f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def label_rows(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of df as a struct `row`, with lang_pred, score and rejected beside it; no name of df can clash.

    Null and empty texts are rejected, repeated rows get a row each, an empty df gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    rows = df.select(row.alias("row"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    at, labelled = df.columns.index(text), _predictor(model)

    def with_text(batches):
        for batch in batches:
            texts = batch.column("row").field(at)
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts, batch.column("letters")], ["key", "text", "letters"])

    kind = rows.schema["row"].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(lambda batches: labelled(with_text(batches)), f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", "row")


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected, learnt from the documents that aren't held out.

    A null doc_id is not held out. Null texts, texts without a letter and very long, repeated or
    clashing rows are as `predict` says; an empty table gives an empty result, and without any
    labelled row everything is `und`.
    """
    model = train(documents.where(~held_out(5, 0)).select("doc_id", "text", "lang"), F.col("doc_id"))
    return predict(documents, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")
