"""Cutting the lineage of iterative plans, and folders for stored tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


_ADAPTIVE = "spark.sql.adaptive.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local session without one gets one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{os.path.abspath('spark-warehouse')}/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/lucerna-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """The rows checkpointed in the folder all executors share.

    `dealt` rows keep what is known of how they are dealt out to tasks, which
    an adaptive plan forgets, so that grouping by it shuffles nothing.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not dealt:
        return df.checkpoint()
    adaptive = spark.conf.get(_ADAPTIVE)
    spark.conf.set(_ADAPTIVE, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(_ADAPTIVE, adaptive)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out to as many tasks as a shuffle has: a small file of many rows is read by one task, which much work on each row would keep busy."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
