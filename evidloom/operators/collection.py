"""The typed collection: image, text, frame and transcript rows of all assets under one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLLECTION = "id bigint, asset_name string, modality string, content_type string, content_ref string, timestamp double, coordinates string, vector array<float>"
#: Fixed value: longest reference kept.
REFERENCE = 1000
TRANSCRIPT = 500


def full(vector: Column) -> Column:
    return F.coalesce(F.size(vector) > 0, F.lit(False))


def document_rows(images: DataFrame, chunks: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Rows of documents from embedded images (asset, name, page_idx, bbox, vector) and chunks; pages count from one.

    An image refers to its URL in ``urls`` (asset, name, url), else to its name. Rows without a vector are left out.
    """
    shown = images.filter(full(F.col("vector")))
    shown = shown.join(urls, ["asset", "name"], "left") if urls is not None else shown.withColumn("url", F.lit(None).cast("string"))

    def rows(df: DataFrame, kind: str, reference: Column) -> DataFrame:
        return df.select(F.col("asset").alias("asset_name"), F.lit("pdf").alias("modality"), F.lit(kind).alias("content_type"), reference.alias("content_ref"), (F.col("page_idx") + 1).cast("double").alias("timestamp"), F.coalesce(F.to_json("bbox"), F.lit("[]")).alias("coordinates"), "vector")

    said = chunks.filter(full(F.col("vector")))
    return rows(shown, "image", F.coalesce("url", "name")).unionByName(rows(said, "text", F.substring("text_slice", 1, REFERENCE)))


def video_rows(features: DataFrame) -> DataFrame:
    """Rows of videos from features (asset, timestamp, frame_name, img_vector, text_vector, content): one for each vector it has."""
    frame = F.struct(F.lit("image_frame").alias("content_type"), F.col("frame_name").alias("content_ref"), F.col("img_vector").alias("vector"))
    said = F.struct(F.lit("transcript_context").alias("content_type"), F.substring("content", 1, TRANSCRIPT).alias("content_ref"), F.col("text_vector").alias("vector"))
    each = features.select("asset", "timestamp", F.explode(F.filter(F.array(frame, said), lambda s: full(s["vector"]))).alias("s"))
    return each.select(F.col("asset").alias("asset_name"), F.lit("video").alias("modality"), "s.content_type", "s.content_ref", F.col("timestamp").cast("double").alias("timestamp"), F.lit("null").alias("coordinates"), "s.vector")


def with_ids(rows: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Rows with ids of their own, above all of the collection ``after``; ingesting an asset again makes new rows."""
    last = after.agg(F.max("id")).first()[0] if after is not None else None
    return rows.select((F.monotonically_increasing_id() + (0 if last is None else last + 1)).alias("id"), "*")


def counts(collection: DataFrame) -> DataFrame:
    return collection.groupBy("asset_name").agg(F.count(F.lit(1)).alias("n_rows"))
