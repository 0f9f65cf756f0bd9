"""Exact ranks inside large groups without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import buckets_for


def exact_rank(df: DataFrame, part: str, order: list[str], rows: int, name: str, parts: int = 16) -> DataFrame:
    """df with name: ranks 0, 1, ... without gaps inside each value of part.

    Rows are dealt into hash buckets of about 50,000 (rows: how many there are); only a bucket is
    sorted, and buckets are put one after the other by their sizes, a table of parts x buckets rows.
    """
    buckets = buckets_for(rows, per_bucket=50_000 * parts, least=max(1, 256 // parts))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(part, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(part, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    return ranked.join(sizes, [part, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_bucket", "_at", "_before")


def place(rank: Column, sizes: list[int]) -> tuple[Column, Column]:
    """(index, offset): which of consecutive intervals of these sizes a rank falls into, and its place there."""
    index, start, at = F.lit(None).cast("int"), F.lit(None).cast("long"), sum(sizes)
    for i in reversed(range(len(sizes))):
        at -= sizes[i]
        here = (rank >= at) & (rank < at + sizes[i])
        index, start = F.when(here, F.lit(i)).otherwise(index), F.when(here, F.lit(at).cast("long")).otherwise(start)
    return index, rank - start
