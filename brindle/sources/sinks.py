"""Sinks: JSON reports, model tables, and checksums of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPARSE = "brindle.sparse.v1"


def write_reports(reports: DataFrame, path: str) -> None:
    """One JSON document a line; the commit protocol makes the write all or nothing."""
    reports.select("report").write.mode("error").text(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of the files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.substring_index("path", "/", -1).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose checksum differs, or that one side lacks."""
    j = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def save_weights(weights: DataFrame, path: str, dimensions: int, updates: int = 0) -> None:
    """A sparse model as a table of (index, weight); every row names the format, the dimensions and the number of updates."""
    weights.select("index", "weight", F.lit(dimensions).alias("dimensions"), F.lit(updates).alias("updates"), F.lit(SPARSE).alias("format")).write.mode("error").parquet(path)


def load_weights(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    d = spark.read.parquet(path)
    if "format" not in d.columns:
        raise ValueError("not a sparse model")
    ok = F.when((F.col("format") == SPARSE) & (F.col("dimensions") == dimensions) & F.col("index").between(-1, dimensions - 1), True).otherwise(F.raise_error(F.lit("weights of another format or other dimensions")).cast("boolean"))
    return d.filter(ok).select("index", "weight")
