"""All registered queries of the library itself."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans.tables_sql import oracle
from shelfwise.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a query over the library's tables; ``sql`` is its DuckDB twin over the same tables."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(Tables(spark, sf_dir))

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = oracle(sql)
        return f

    return add


for _module in ("asset_queries", "pair_queries", "contact_queries", "signal_queries", "review_queries", "stream_queries"):
    importlib.import_module(f"shelfwise.plans.{_module}")
