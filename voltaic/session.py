"""A session with the settings that the operators count on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere (local clocks are computed, never ambient); AQE joins, skew splits and coalescing at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "voltaic", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and all executors are on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return tempfile.mkdtemp(prefix="voltaic-")


def shared_folder(spark: SparkSession) -> str:
    """The session's own folder in the one that spark.checkpoint.dir names, which all executors see."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(spark))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder of spark.checkpoint.dir.

    For what must be the same wherever it is read again, such as the number of the partition that a row lies in.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 64) -> Iterator[None]:
    """While this lasts, actions send so many rows at once to Python workers: for rows of large geometries, whose batches must fit in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
