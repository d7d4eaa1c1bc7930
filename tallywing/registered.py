"""The registered queries of the library and the SQL that each can be held against."""

from __future__ import annotations

from collections.abc import Callable

from .plans import ORACLES, QUERIES, climatology_plans, explore_plans, metric_plans, source_plans, survey_plans, verification_plans, weather_plans  # noqa: F401


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
