"""Reading the star-schema tables, and a registry that keeps each query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables by name: t.orders reads orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its own name, with the SQL that gives the same rows."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable:
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def scaled6(column: str) -> Column:
    """Six places as DuckDB's round gives them: at a million and more the product's last bit decides, not the decimal digits."""
    return F.round(F.col(column) * 1e6) / 1e6


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)
