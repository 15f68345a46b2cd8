"""Outlines of assets: what a model is told of them, and what it answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import iso_stamp, unfenced
from evidloom.operators.backends import Answerer, answered, echo, rendered

#: Fixed value: most characters of an asset that a model is given.
CONTEXT = 50_000
_POINT = "heading:string,anchor:double,summary:string"
OUTLINE = f"struct<title:string,outline:array<struct<{_POINT},sub_points:array<struct<{_POINT}>>>>>"


def document_context(contents: DataFrame) -> DataFrame:
    """(asset, context) of content lists (asset, content), capped."""
    return contents.select("asset", F.substring("content", 1, CONTEXT).alias("context"))


def transcript_context(segments: DataFrame) -> DataFrame:
    """(asset, context) of segments (asset, start, segment_id, text): ``[start s]: text`` lines in order, capped."""
    line = F.concat(F.lit("["), F.col("start").cast("string"), F.lit("s]: "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("segment_id", line.alias("line")))), lambda x: x["line"])
    return segments.groupBy("asset").agg(F.substring(F.array_join(lines, "\n"), 1, CONTEXT).alias("context"))


def outlined(contexts: DataFrame, template: str, backend: Answerer = echo, now: Column | None = None) -> DataFrame:
    """(asset_id, generated_at, outline, failed) of contexts (asset, asset_type, context); an answer that isn't an outline fails."""
    asked = contexts.withColumn("prompt", rendered(template, raw_context=F.col("context"), asset_type=F.col("asset_type")))
    said = answered(asked, "prompt", F.col("context").isNotNull(), backend)
    found = said.withColumn("outline", F.from_json(unfenced(F.col("answer")), OUTLINE))
    failed = F.coalesce(F.col("outline.outline").isNull(), F.lit(True))
    return found.select(F.col("asset").alias("asset_id"), iso_stamp(F.current_timestamp() if now is None else now).alias("generated_at"), "outline", failed.alias("failed"))
