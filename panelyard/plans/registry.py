"""The registry that the driver reads, and how a plan opens a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its own name, with the SQL that gives the same rows."""

    def register(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLE[plan.__name__] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: str) -> Column:
    """Rounded to 6 digits under its own name, so that the last bits of sums don't matter."""
    return F.round(column, 6).alias(column)
