"""All queries of the library with the SQL that says what they return.

A query is a function of (spark, sf_dir); `query` registers it under a name that begins with the
"""

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


for _part in ("text", "features", "labels", "pools", "sets", "profiles", "samples", "evaluation", "fusion", "tabular", "models", "cases", "records", "structure"):
    import_module(f"sluice.plans.{_part}")
