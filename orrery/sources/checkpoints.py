"""The folder for checkpoints: the session's own setting; where none is set, a temporary one in local mode only."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not (named := context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-orrery-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named
