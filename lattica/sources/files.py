"""Files as rows: their contents, when they changed, and chains of operations on them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """id (the path), content, mtime in seconds, and size of the files at a path or pattern."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("id"), "content", F.unix_millis("modificationTime").cast("double").alias("ms"), F.col("length").alias("size")).select("id", "content", (F.col("ms") / 1000).alias("mtime"), "size")


def stale(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that are not in the cache (id, mtime), or have changed since."""
    known = cached.select("id", F.col("mtime").alias("cached_mtime"))
    return files.join(known, "id", "left").where(F.col("cached_mtime").isNull() | (F.col("mtime") > F.col("cached_mtime"))).drop("cached_mtime")


def pipe(df: DataFrame, *operations: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operations one after another."""
    return reduce(lambda d, f: d.transform(f), operations, df)
