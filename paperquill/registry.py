"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    """A value as DuckDB writes it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value).lower()
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'"


#: Types of columns of hand-written rows, as DuckDB names them.
_SQL_TYPES = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}


@dataclass(frozen=True)
class Rows:
    """Hand-written rows, which a query and its SQL both read. columns: 'name type, ...'."""

    columns: str
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.columns)

    @property
    def sql(self) -> str:
        kinds = [c.split(None, 1) for c in self.columns.split(", ")]
        cast = ", ".join(f"CAST({n} AS {_SQL_TYPES[k]}) AS {n}" for n, k in kinds)
        return f"(SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in self.rows)}) v({', '.join(n for n, _ in kinds)}))"
