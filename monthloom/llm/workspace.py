"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from monthloom.session import checkpoint_folder


def new_folder(spark: SparkSession, what: str) -> str:
    """The name of a folder that does not exist yet, under ``spark.checkpoint.dir``."""
    return f"{checkpoint_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` and go on from the written table, so that later steps neither repeat nor lose the work."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
