"""Where jobs in several steps keep what they have so far: the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where a local master leaves it unset, a temporary folder of its one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared.rstrip("/") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lost executors cost no recomputation of earlier steps."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
