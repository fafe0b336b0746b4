"""Frames that several branches of a plan read, written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local master gets a temporary one, and a cluster an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        told = tempfile.mkdtemp(prefix="tidemill-")
        spark.sparkContext.setCheckpointDir(told)
    return told


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: a plan that uses it twice does its work once, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
