"""Fits of all groups at once against plain fits of each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywing.operators import fitting, training
from tallywing.registry import HYPERPARAMETERS

FEATURES = ["a", "b"]


def made(species, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    exposure = rng.uniform(0.5, 2, n)
    count = rng.poisson(exposure * np.exp(0.4 + 0.5 * x[:, 0] - 0.3 * x[:, 1])).astype(float)
    return pd.DataFrame({"species": species, "count": count, "exposure": exposure, "held": rng.random(n) < 0.25, "a": x[:, 0], "b": x[:, 1]})


def losses(y, mu, weight, power, terms):
    loss, slope = np.zeros(len(y)), np.zeros(len(y))
    for name, share in terms.items():
        if name == "tweedie":
            m, share = mu + 1e-8, share * weight
            loss += share * (m ** (2 - power) / (2 - power) - y * m ** (1 - power) / (1 - power))
            slope += share * (mu ** (2 - power) - y * mu ** (1 - power))
        elif name == "squared_log":
            d = np.log1p(mu) - np.log1p(y)
            loss, slope = loss + share * d**2, slope + share * 2 * d * mu / (1 + mu)
    return loss, slope


def plain(df, rate, decay, weight, power, terms, epochs, patience):
    """Adam on all rows, one group."""
    x = np.c_[np.ones(len(df)), df[FEATURES]]
    y, e, held = df["count"].to_numpy(), df["exposure"].to_numpy(), df["held"].to_numpy()
    w = np.r_[np.log(y[~held].sum() / e[~held].sum()), 0, 0]
    m, v, best, best_w, bad, plateau, flat = 0 * w, 0 * w, np.inf, w, 0, np.inf, 0
    for t in range(1, epochs + 1):
        loss, slope = losses(y, e * np.exp(x @ w), weight, power, terms)
        judged = loss[held].mean()
        if judged < best:
            best, best_w, bad = judged, w, 0
        else:
            bad += 1
        if plateau == np.inf or judged < plateau - abs(plateau) * 1e-4:
            plateau, flat = judged, 0
        else:
            flat += 1
        if flat > 2:
            rate, flat = rate * 0.1, 0
        g = (slope[~held, None] * x[~held]).mean(0) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if bad >= patience:
            return best_w, best, t, True
    return best_w, best, epochs, False


def test_training_equals_plain_adam_by_group(spark):
    """Rates, decays, weights and powers of the species' own table, one job an epoch for all of them."""
    names = ["Red Kite", "Merlin", "Osprey", "no entry"]
    data = {s: made(s, 300 + 50 * i, i) for i, s in enumerate(names)}
    odd = pd.DataFrame({"species": ["Merlin", None, "held alone"], "count": [np.nan, 1.0, 2.0], "exposure": [1.0, 1.0, 1.0], "held": [False, False, True], "a": 0.0, "b": 0.0})
    rows = spark.createDataFrame(pd.concat([*data.values(), odd]))
    terms = {"tweedie": 1.0, "squared_log": 0.5}
    got = {r.species: r for r in training.train(rows.where("NOT isnan(count)"), training.hyperparameters(spark), FEATURES, terms=terms, epochs=12, patience=3).collect()}
    assert set(got) == {*names, "held alone"}
    for s in names:
        w, best, epochs, stopped = plain(data[s], *HYPERPARAMETERS.get(s, training.DEFAULTS), terms, 12, 3)
        r = got[s]
        assert np.allclose([r.intercept, r.a, r.b], w, atol=1e-9) and abs(r.loss - best) < 1e-9 and (r.epochs, r.stopped) == (epochs, stopped)


def test_training_stops_early_and_goes_on_where_it_stopped(spark, tmp_path):
    data = {"x": made("x", 200, 7), "y": made("y", 200, 8)}
    rows = spark.createDataFrame(pd.concat(data.values()))
    hyper = spark.createDataFrame([("x", 3.0, 0.0, 1.0, 1.5), ("y", 0.05, 0.0, 1.0, 1.2)], "species string, rate double, decay double, weight double, power double")
    first = training.train(rows, hyper, FEATURES, epochs=4, patience=3, folder=str(tmp_path))
    assert {r.epochs for r in first.collect()} == {4}
    got = {r.species: r for r in training.train(rows, hyper, FEATURES, epochs=9, patience=3, folder=str(tmp_path)).collect()}
    for s, h in (("x", (3.0, 0.0, 1.0, 1.5)), ("y", (0.05, 0.0, 1.0, 1.2))):
        w, best, epochs, stopped = plain(data[s], *h, {"tweedie": 1.0}, 9, 3)
        assert np.allclose([got[s].intercept, got[s].a, got[s].b], w, atol=1e-9) and (got[s].epochs, got[s].stopped) == (epochs, stopped)
    assert got["x"].stopped and got["x"].epochs < 9 and got["y"].epochs == 9  # a group that is done rests while the other goes on
    predicted = training.expected(training.train(rows, hyper, FEATURES, epochs=9, patience=3, folder=str(tmp_path)), rows, FEATURES)
    assert predicted.count() == 400 and {r.species for r in training.skill(predicted).collect()} == {"x", "y"}


def test_unknown_loss_and_no_rows(spark):
    rows = spark.createDataFrame(made("x", 20, 1)).where("false")
    with pytest.raises(ValueError, match="unknown losses"):
        training.train(rows, None, FEATURES, terms={"other": 1.0})
    assert training.train(rows, None, FEATURES).count() == 0


def test_regressions_of_all_groups_equal_those_of_each(spark):
    rng = np.random.default_rng(3)
    n = 900
    df = pd.DataFrame({"species": rng.integers(0, 3, n), "doy": rng.integers(196, 336, n), "hour": rng.integers(5, 19, n)})
    df["rate"] = rng.gamma(1.5, 1 + df.species + np.sin(df.doy / 30)) * (rng.random(n) < 0.7)
    rows = spark.createDataFrame(df)
    got = {r.species: r for r in fitting.fit_tweedie_each(rows, 1.5).collect()}
    for s in range(3):
        glm = fitting.fit_tweedie(rows.where(F.col("species") == s), 1.5).stages[-1]
        assert np.allclose([got[s].intercept, *[got[s][f] for f in fitting.FEATURES]], [glm.intercept, *glm.coefficients], rtol=1e-5, atol=1e-6)
    zeros = rows.unionByName(rows.where("species = 0").withColumns({"species": F.lit(9).cast("long"), "rate": F.lit(0.0)})).unionByName(rows.limit(1).withColumns({"species": F.lit(0).cast("long"), "rate": F.lit(None).cast("double")}))
    more = {r.species: r for r in fitting.fit_tweedie_each(zeros, 1.5).collect()}
    assert more[9].intercept is None and abs(more[0].intercept - got[0].intercept) < 1e-12


def test_query_trains_until_no_species_gains(spark, small, monkeypatch):
    """The query bounds neither epochs nor patience: both are the operator's own."""
    from tallywing.plans import explore_plans

    given = {}
    monkeypatch.setattr(explore_plans.training, "train", lambda rows, hyper, features, **more: given.update(more) or rows)
    rows = explore_plans.trained_models(spark, small)
    assert not given and rows.count() > 0
