"""Tables that a query writes for itself, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir; on one machine, where that is unset, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all machines share")
        folder = spark.conf.get("pitchside.tables", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="pitchside-tables-")
            spark.conf.set("pitchside.tables", folder)
    return f"{folder}/{spark.sparkContext.applicationId}-tables/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: used more than once, computed once, and safe from lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
