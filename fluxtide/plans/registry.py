"""All registered queries and their SQL.

A query is registered with the SQL that DuckDB runs over the same tables, where SQL can say
it, and with the places to which its doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, doubles: str = "", places: int = 6):
    """Decorator: registers the function by its name; ``doubles`` are rounded."""
    names = doubles.split()

    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df.withColumns({n: F.round(n, places) for n in names}) if names else df

        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        if sql:
            rounded = f"SELECT * REPLACE ({', '.join(f'round({n}, {places}) AS {n}' for n in names)}) FROM ({sql})"
            ORACLE_SQL[build.__name__] = rounded if names else sql
        return build

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from . import benchmark, catalogues, checks, evaluation, lightcurves, models, runs, scoring, studies  # noqa: F401
