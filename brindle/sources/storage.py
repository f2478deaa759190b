"""Cutting plans by tables, so that what several branches read is made once and survives lost executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir or the context names it; only a local master gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or "/tmp/brindle-checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a table in the shared folder, which goes when the driver ends; its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
