"""Fits, predictions and samples cover every species."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywing import registered
from tallywing.operators import fitting
from tallywing.plans import adapters

QUERIES = registered.queries()


@pytest.fixture(scope="module")
def surveys(spark, small):
    return adapters.hour_surveys(spark, small).cache()


def test_surfaces_coefficients_and_samples_of_every_species(spark, small, surveys):
    every = {r.species for r in surveys.select("species").distinct().collect()}
    count = lambda name: {r["species"]: r["count"] for r in QUERIES[name](spark, small).groupBy("species").count().collect()}
    assert len(every) > 3
    assert count("ratio_gam") == dict.fromkeys(every, 366 * 24)
    assert count("tweedie_fit") == dict.fromkeys(every, 5)
    assert count("weighted_days") == dict.fromkeys(every, 50)


def test_predictions_of_every_row_are_those_of_its_species_model(spark, small, surveys):
    got = QUERIES["batch_prediction"](spark, small).toPandas()
    assert len(got) == surveys.count()
    for species in (0, 3):
        rows = surveys.where(F.col("species") == species)
        want = fitting.predict(fitting.fit_tweedie(rows, 1.5), rows).orderBy("date", "hour").toPandas()
        own = got[got.species == species].sort_values(["date", "hour"])
        assert len(own) == len(want) and np.allclose(own.expected, want.expected, rtol=1e-6)
