"""Named queries over the driver tables, each with the SQL its result is checked against (where SQL can say it)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = ["traffic", "audit_queries", "encounter_queries", "airspace_queries", "picture_queries", "space_queries", "orbit_queries", "risk_queries", "source_queries", "model_queries", "text_queries", "vision_queries", "product_queries", "stream_queries", "board_queries"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tune(spark: SparkSession) -> None:
    """Runtime settings the plans assume; everything about sizes is left to the cluster's configuration."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # wide projections: above 8 KB of bytecode the JVM would not compile the fused method
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"airlens.plans.{m}")
