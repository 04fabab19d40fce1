"""Name to query and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.ctes import query
from catalog.snap import snapped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a builder; its result is shown with snapped doubles and times as text."""
    def wrap(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return snapped(build(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = query(sql)
        return build

    return wrap
