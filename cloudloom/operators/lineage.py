"""Cutting the lineage of a table, so that a lost executor costs one step and not all of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that queries leave, below the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cloudloom-")
    return f"{base.rstrip('/')}/cloudloom/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame) -> DataFrame:
    """df as a checkpoint in spark.checkpoint.dir, the folder that all executors share. Only a local session without that setting gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="cloudloom-"))
    return df.checkpoint()
