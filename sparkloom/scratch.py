"""Cutting lineage in iterative operators: reliable checkpoints in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in spark.checkpoint.dir; a folder of our own is set only where none is configured."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            held = tempfile.TemporaryDirectory(prefix="sparkloom-core-")
            atexit.register(held.cleanup)
            where = f"file://{held.name}"
        sc.setCheckpointDir(where)
    return df.checkpoint()


def workers_find_us(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
