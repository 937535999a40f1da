"""A registry of queries: name to (function of spark and folder, SQL that gives the same rows or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


#: The white space of identity normalisation, in SQL.
NORM = r"regexp_replace(regexp_replace({x}, '[\t\n\r\f\x0B \x{{00a0}}]+', ' ', 'g'), '^ | $', '', 'g')"


def norm(x: str) -> str:
    return NORM.format(x=x)
