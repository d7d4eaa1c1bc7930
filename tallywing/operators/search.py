"""Search for hyperparameters: a tree-structured Parzen estimator that proposes several trials at once.

A few numbers a trial stay on the driver. The trials of a batch are evaluated together: as groups
of one training job (`tuned`), or as jobs side by side (`jobs`).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import ceil, erf, exp, inf, isfinite, log, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training

# Trials, random ones among them, seed, and the ranges searched.
TRIALS, STARTUP, SEED = 50, 20, 1234
CANDIDATES, BEST_SHARE, MOST_BEST = 24, 0.1, 25


@dataclass(frozen=True)
class Range:
    """Values between low and high, drawn evenly or by their logarithm."""

    low: float
    high: float
    log: bool = False

    def __post_init__(self):
        if not self.low < self.high or self.log and self.low <= 0:
            raise ValueError(f"no range: {self}")

    def inner(self, value: float) -> float:
        return log(value) if self.log else value

    def outer(self, x: float) -> float:
        return min(self.high, max(self.low, exp(x) if self.log else x))

    @property
    def ends(self) -> tuple[float, float]:
        return self.inner(self.low), self.inner(self.high)


SPACE = {"rate": Range(0.0001, 0.1), "decay": Range(0.0001, 0.1), "power": Range(1.0, 2.0), "weight": Range(0.01, 10.0)}


@dataclass(frozen=True)
class Trial:
    point: dict[str, float]
    value: float


class _Parzen:
    """Normal curves cut off at the ends of a range, one about each value and a wide one over all, of equal weight."""

    def __init__(self, values: Sequence[float], ends: tuple[float, float]):
        low, high = self.ends = ends
        at = np.array([*values, (low + high) / 2])
        order = np.argsort(at, kind="stable")
        gaps = np.diff(np.r_[low, at[order], high])
        width = np.empty(len(at))
        width[order] = np.maximum(gaps[:-1], gaps[1:])
        width = np.clip(width, (high - low) / min(100, 1 + len(at)), high - low)
        width[-1] = high - low
        self.at, self.width = at, width
        below = lambda x: np.array([(1 + erf(v / sqrt(2))) / 2 for v in x])
        self.inside = below((high - at) / width) - below((low - at) / width)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = []
        while len(out) < n:  # a curve's mean lies inside, so half of its draws at least do in one direction
            i = rng.integers(len(self.at))
            x = rng.normal(self.at[i], self.width[i])
            if self.ends[0] <= x <= self.ends[1]:
                out.append(x)
        return np.array(out)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.at) / self.width
        return np.log((np.exp(-z * z / 2) / (sqrt(2 * pi) * self.width * self.inside)).mean(1) + 1e-300)


def _proposed(trials: Sequence[Trial], space: Mapping[str, Range], rng: np.random.Generator) -> dict[str, float]:
    """The point, coordinate by coordinate, at which good trials are densest compared with the others."""
    ranked = sorted(trials, key=lambda t: -t.value)
    n = min(MOST_BEST, ceil(BEST_SHARE * len(ranked)))
    point = {}
    for name, r in space.items():
        good, rest = (_Parzen([r.inner(t.point[name]) for t in some], r.ends) for some in (ranked[:n], ranked[n:]))
        x = good.draw(rng, CANDIDATES)
        point[name] = r.outer(float(x[np.argmax(good.log_density(x) - rest.log_density(x))]))
    return point


def search(evaluate: Callable[[list[dict[str, float]]], Sequence[float | None]], space: Mapping[str, Range], trials: int = TRIALS, startup: int = STARTUP, seed: int = SEED, together: int = 5, done: Sequence[Trial] = ()) -> list[Trial]:
    """Trials in order, of which the largest value is the best; `best` picks it.

    evaluate gets the points of up to `together` trials and gives a value for each; null or a value
    that isn't finite is a failed trial, which counts as the worst. The first `startup` points are
    random, each later batch comes from all finished trials, those of its own batch standing in with
    the worst value. The same seed and values give the same points; `done` are trials of an earlier
    run, which count.
    """
    found, low = list(done), -inf
    while len(found) < trials:
        rng = np.random.default_rng([seed, len(found)])
        points: list[dict[str, float]] = []
        finite = [t.value for t in found if isfinite(t.value)]
        low = min(finite, default=0.0)
        for _ in range(min(together, trials - len(found))):
            if len(found) + len(points) < startup or not finite:
                points.append({name: r.outer(float(rng.uniform(*r.ends))) for name, r in space.items()})
            else:
                known = [Trial(t.point, t.value if isfinite(t.value) else low) for t in found] + [Trial(p, low) for p in points]
                points.append(_proposed(known, space, rng))
        values = list(evaluate(points))
        if len(values) != len(points):
            raise ValueError(f"{len(points)} trials have {len(values)} values")
        found += [Trial(p, float(v) if v is not None and isfinite(v) else -inf) for p, v in zip(points, values, strict=True)]
    return found


def best(trials: Sequence[Trial]) -> Trial:
    return max(trials, key=lambda t: t.value)


def jobs(one: Callable[[dict[str, float]], float], most: int = 5) -> Callable[[list[dict[str, float]]], list[float]]:
    """An evaluation that runs each trial of a batch in a thread, so that their Spark jobs run side by side."""

    def evaluate(points: list[dict[str, float]]) -> list[float]:
        with ThreadPoolExecutor(most) as pool:
            return list(pool.map(one, points))

    return evaluate


def tuned(rows: DataFrame, features: Sequence[str], space: Mapping[str, Range] = SPACE, terms: Mapping[str, float] | None = None, epochs: int = 50, **how) -> list[Trial]:
    """Trials over the hyperparameters of `training.train`, by the mean over the groups of the held rows' explained variance.

    rows are those of `train`, with the groups in `species`. A batch of trials is one training: every
    row meets the models of all its trials where it is.
    """
    spark = rows.sparkSession

    def evaluate(points: list[dict[str, float]]) -> list[float | None]:
        table = spark.createDataFrame([(i, *(float(p.get(h, d)) for h, d in zip(training.HYPER, training.DEFAULTS, strict=True))) for i, p in enumerate(points)], "trial int, " + ", ".join(f"{h} double" for h in training.HYPER))
        group = lambda df: df.withColumn("species", F.struct("trial", "species")).drop("trial")
        every = group(rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1)))))
        hyper = group(rows.select("species").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1)))).join(table, "trial"))
        models = training.train(every, hyper, features, terms=terms, epochs=epochs)
        scores = training.skill(training.expected(models, every, features)).select("species.trial", "r2").groupBy("trial").agg(F.avg("r2").alias("r2")).collect()
        by_trial = {r["trial"]: r["r2"] for r in scores}
        return [by_trial.get(i) for i in range(len(points))]

    return search(evaluate, space, **how)
