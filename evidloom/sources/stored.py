"""Tables between the steps of an operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The session's setting for shared storage.
SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; only a session in one process may have one of its own instead."""
    found = spark.conf.get(SHARED_DIR, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{SHARED_DIR} must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once: what is numbered or dealt out by ranges stays so when a task runs again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidloom-step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
