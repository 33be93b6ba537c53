"""Queries by key, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioframe.plans.views import Inputs, oracle
from folioframe.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STATEMENTS: dict[str, str] = {}  # the oracle texts before the views are put in front


def query(key: str, sql: str | None = None) -> Callable[[Callable[[Inputs], DataFrame]], Callable[[Inputs], DataFrame]]:
    """Register a function of the inputs under a key."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Inputs(configure(spark), folder))

        run.__doc__ = build.__doc__
        QUERIES[key] = run
        if sql is not None:
            STATEMENTS[key] = sql
            ORACLES[key] = oracle(sql)
        return build

    return register
