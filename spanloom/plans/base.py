"""What the query modules share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrar() -> tuple[dict, dict, Callable]:
    queries, sql = {}, {}

    def register(oracle: str | None = None):
        def take(f):
            queries[f.__name__] = f
            if oracle:
                sql[f.__name__] = oracle
            return f

        return take

    return queries, sql, register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql_over(spark: SparkSession, sf_dir: str, query: str, *tables: str) -> DataFrame:
    """A query over tables, read as frames of its own: no view of the caller's session is touched."""
    for t in tables:
        query = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", query)
    return spark.sql(query, **{t: load(spark, sf_dir, t) for t in tables})


def values(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def sql_values(rows: list[tuple]) -> str:
    """Rows as a SQL VALUES list."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def lit_in(col: Column, items) -> Column:
    return col.isin(*items)
