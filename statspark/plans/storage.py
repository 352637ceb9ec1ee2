"""Checkpoints in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The configured checkpoint folder; a local one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="statspark-"))
    return configured or jsc.getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and cut from their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
