"""Cutting lineage between the rounds of an iteration, and a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of ``spark.checkpoint.dir``."""
    _prepared(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new path in that folder, for files that a later step reads again."""
    return f"{_prepared(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _prepared(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Only where no folder is set and the master is local, as in tests, a temporary
    one is; on a cluster executors could not share it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='sitewise-')}")
    return sc.getCheckpointDir()
