"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as it is now, from files in that folder.

    Files are written once and have their true size, while Spark's checkpoint works everything out twice and keeps the
    estimated size of its plan, which is squared by each round of joins until planning takes longer than the work.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
