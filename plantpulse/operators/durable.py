"""Results that later steps read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Where none is named, a session in one process gets a scratch folder; on a
    cluster only the driver would see that, so there a folder has to be named.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plantpulse-"))
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that every executor can write to."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there.

    The files outlive executors, so a lost one costs a re-read, not a re-run,
    and every reader sees the same rows.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
