"""Registry of the runnable queries and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` together with the SQL that states the same result."""
    def register(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return job(Tables(configure(spark), sf_dir))
        run.__name__ = name
        run.__doc__ = job.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return job
    return register


# Tables whose rows carry long texts or vectors, so that work per row and not per byte read dominates.
HEAVY = {"documents", "pages", "embeddings"}


class Tables:
    """The given tables of one scale folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in HEAVY else table
