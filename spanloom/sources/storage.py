"""Small files on any storage that Spark reads (HDFS, object stores, local disks), through Hadoop's file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it doesn't exist."""
    at, fs = _at(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def create_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A new file; one that exists is an error unless overwrite is set."""
    at, fs = _at(spark, path)
    out = fs.create(at, overwrite)
    out.write(bytearray(text.encode()))
    out.close()
