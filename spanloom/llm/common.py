"""Small helpers the corpus operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.components import cut

__all__ = ["buckets_for", "byte_batches", "cut", "held_out", "sample_order", "shuffle_width", "table", "words"]

#: Bytes of an Arrow batch, for operators whose rows hold whole texts.
BATCH_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(col: str = "doc_id") -> Column:
    """Whether crc32 of the decimal id modulo 4 is 2; false for null ids."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def sample_order(col: str = "doc_id") -> Column:
    """An order for bounded samples that has nothing to do with held_out()."""
    return F.xxhash64(F.col(col).cast("string"), F.lit("sample"))


def words(col: Column) -> Column:
    """White-space separated words of a text; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"\s+"), lambda w: w != "")


def buckets_for(rows: int, per_bucket: int = 100_000, least: int = 64) -> int:
    """Buckets that keep each of them near per_bucket rows, at least so many."""
    return max(least, math.ceil(rows / per_bucket))


def byte_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, whatever the query before has set; a session's own smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)
