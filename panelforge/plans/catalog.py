"""Registered queries over the supplied tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, list[str]] = {}


class Tables:
    """The tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def shaped(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, whole numbers as bigint, for comparison across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            c = F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0))
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, ops: str, sql: str | None = None, doubles: str = "", ints: str = "", digits: int = 6):
    """Register ``fn(tables)`` under a name, with the operators of the inventory it shows."""

    def add(fn):
        QUERIES[name] = lambda spark, path: shaped(fn(Tables(spark, path)), digits)
        OPERATORS[name] = ops.split()
        if sql is not None:
            casts = [f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split()]
            casts += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            ORACLE[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS q" if casts else sql
        return fn

    return add
