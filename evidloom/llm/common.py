"""What the training-data operators share: tables, shared storage and small column helpers."""

from __future__ import annotations

import ctypes
import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
#: As a regular expression for JVM functions.
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
#: The session's setting for storage that the driver and all executors share.
SHARED_DIR = "spark.checkpoint.dir"
#: The session's setting for the bytes of a batch that goes to a Python worker, and what ``small_batches`` sets it to.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session in one process may have one of its own instead."""
    found = spark.conf.get(SHARED_DIR, None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{SHARED_DIR} must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    return found


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once to shared storage: later stages and lost executors reread them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote; for tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers get batches of about ``BATCH_BYTES``, one row at least, however long the texts are."""
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Memory that this process has freed goes back to the system: a Python worker outlives its tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, and then what it held goes back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def text_of(col: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def pieces_of(total: int, size: int, least: int = 8) -> int:
    """How many pieces of about ``size`` a total makes; the count follows the data."""
    return max(least, -(-int(total) // size))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have in any letter case."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def log_factorial(x: Column) -> Column:
    """Natural logarithm of x!; Stirling's series from 16 on."""
    x = x.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(x < 16, F.log(F.factorial(F.least(x, F.lit(16)).cast("int")).cast("double"))).otherwise(series)
