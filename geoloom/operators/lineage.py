"""Written intermediate tables that cut lineage in loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir, as in local tests.
LOCAL_DIR = "/tmp/checkpoints/geoloom"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared checkpoint folder, read back; lost executors cost running tasks only."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
