"""Cutting lineage in storage that every executor can read."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    ``spark.checkpoint.dir`` wins. Where it is unset, a folder of this machine
    is used in local mode only; on a cluster the setting is required.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows are written once, later jobs read them back.

    The files survive lost executors and are removed by Spark's context
    cleaner (``spark.cleaner.referenceTracking.cleanCheckpoints``) once no plan
    refers to them.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared checkpoint folder and read back.

    For loops that join a table with itself round after round: a checkpoint
    keeps the planner's estimate of its size, which a join multiplies, so that
    after some twenty rounds planning takes longer than the work. A file's size is known.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
