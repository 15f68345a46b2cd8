"""Assets as a stream: each file goes through the states, batch by batch, with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What each state leads to; an error leads to Failed, where it ends.
NEXT = {"Uploading": "Raw", "Raw": "recognizing", "recognizing": "Cliping", "Cliping": "Structuring", "Structuring": "Ingesting", "Ingesting": "Ready"}
Step = Callable[[DataFrame], DataFrame]


def next_state(status: Column, failed: Column) -> Column:
    states = F.create_map(*(F.lit(x) for kv in NEXT.items() for x in kv))
    return F.when(F.coalesce(failed, F.lit(False)) & ~status.isin("Ready"), "Failed").otherwise(F.coalesce(F.try_element_at(states, status), status))


def advanced(assets: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """Assets after all steps: ``steps`` has a function for a state, from assets to the same with ``failed``.

    The state is set before its step runs; an asset that fails stays as Failed and runs no more.
    """
    rows = assets
    for state in ("recognizing", "Cliping", "Structuring", "Ingesting"):
        rows = rows.withColumn("status", F.when(F.col("status") == [k for k, v in NEXT.items() if v == state][0], state).otherwise(F.col("status")))
        if state in steps:
            here = F.col("status") == state
            done = steps[state](rows.filter(here))
            done = done.withColumn("status", F.when(F.coalesce("failed", F.lit(False)), "Failed").otherwise(F.col("status"))).drop("failed")
            rows = rows.filter(~here).unionByName(done)
    return rows.withColumn("status", F.when(F.col("status") == "Ingesting", "Ready").otherwise(F.col("status")))


def ingest(spark: SparkSession, source: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, files_a_batch: int = 1) -> StreamingQuery:
    """New Parquet files in order of arrival, ``files_a_batch`` at a time, to ``each``; stops when all are seen.

    After a restart the checkpoint says what was done; ``each`` gets a batch's number, so it can write it once.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts for each type and window of time, on a stream or a table; on a stream, events later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begins"), "event_type", "n")
