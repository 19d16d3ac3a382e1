"""Results that are computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed, so that whoever reads it, or reads it again after a loss, finds the same rows."""
    _shared(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
