"""Every query of the library by name, with the DuckDB SQL of its rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import attribution_queries, bundle_queries, capture_queries, composite_queries, fact_queries, outcome_queries, read_queries, report_queries, rollout_queries, stream_queries, training_queries  # noqa: F401  they register their queries
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "a01_ci_resolution"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
