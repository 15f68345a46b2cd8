"""Sinks. What replaces a table is written beside it first, so that a lost job leaves the old one whole."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a file and bytes of a row group of tables laid out by id.
FILE_ROWS, GROUP_BYTES = 4_000_000, 16 << 20
#: Sessions of a file of lines.
FILE_SESSIONS = 10_000


def replaced(df: DataFrame, path: str) -> str:
    """Write a new version under ``path`` and add its name, numbered, to ``path/versions``, where readers find the last.

    Nothing is overwritten or deleted: a job lost at any point leaves the version before, and old versions stay.
    """
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark = df.sparkSession
    try:
        last = _versions(spark, path).agg(F.max("n")).first()[0] or 0
    except AnalysisException:  # no version yet
        last = 0
    spark.createDataFrame([(last + 1, version)], "n bigint, version string").coalesce(1).write.mode("append").json(f"{path}/versions")
    return version


def _versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n bigint, version string").json(f"{path}/versions")


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_versions(spark, path).agg(F.max_by("version", F.struct("n", "version"))).first()[0])


def save_document_features(images: DataFrame, chunks: DataFrame, path: str) -> None:
    """Feature files of documents, one folder for each asset: images by name, and text chunks in order."""
    slot = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("page_idx").cast("int").alias("page_idx"), "text_slice", F.col("vector").alias("embedding"), "bbox")
    shown = images.groupBy("asset").agg(F.map_from_entries(F.collect_list(F.struct("name", slot("image")))).alias("images"))
    said = chunks.groupBy("asset").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "block_idx", slot("text").alias("s")))), lambda x: x["s"]).alias("text_chunks"))
    _by_asset(shown.join(said, "asset", "full"), path)


def save_video_features(features: DataFrame, path: str) -> None:
    """Feature files of videos, one folder for each asset: its frames in order of time, under ``alignments``."""
    frame = F.struct("timestamp", "frame_name", "img_vector", "text_vector", "content", "need_vlm")
    _by_asset(features.groupBy("asset").agg(F.array_sort(F.collect_list(frame)).alias("alignments")), path)


def save_outlines(outlines: DataFrame, path: str) -> None:
    """Outline files (asset_id, generated_at, outline), one folder for each asset."""
    _by_asset(outlines.withColumn("asset", F.col("asset_id")), path)


def _by_asset(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asset").json(path)


def save_sessions(found: DataFrame, path: str) -> None:
    """One folder for each session."""
    found.withColumn("part", F.col("chat_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").json(path)


def save_session_lines(found: DataFrame, path: str) -> None:
    """Sessions of a table in a new folder, one in each line of files of many; a file for each takes too long for large tables."""
    found.write.option("maxRecordsPerFile", FILE_SESSIONS).json(path)


def save_transcripts(segments: DataFrame, path: str) -> None:
    """Segments (asset, language, duration, start, end, segment_id, text) as one file for each asset, times to two places."""
    one = F.struct("segment_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.trim("text").alias("text"))
    rows = segments.groupBy(F.col("asset").alias("asset_id"), "language", F.round("duration", 2).alias("duration")).agg(F.array_sort(F.collect_list(one)).alias("segments"))
    _by_asset(rows.withColumn("asset", F.col("asset_id")), path)


def append_collection(rows: DataFrame, path: str) -> int:
    """Append rows, by modality; how many there were."""
    watched = rows.observe(seen := _observation(), F.count(F.lit(1)).alias("n"))
    watched.write.mode("append").partitionBy("modality").parquet(path)
    return seen.get["n"]


def save_by_id(rows: DataFrame, path: str, id_col: str = "id", file_rows: int = FILE_ROWS, group_bytes: int = GROUP_BYTES) -> int:
    """Write ``rows`` laid out by id, and return how many there were.

    Files hold ranges of ids and are sorted by them, their row groups are small, and each group has a Bloom filter of
    its ids. So a filter on a few ids reads the footers and those few groups that have them; this is what the second
    step of a search counts on. Rows of one id stand together.
    """
    n = rows.count()
    files = max(1, -(-n // file_rows))
    dealt = rows.repartitionByRange(files, id_col).sortWithinPartitions(id_col)
    dealt.write.option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{id_col}", "true").option(f"parquet.bloom.filter.expected.ndv#{id_col}", min(file_rows, 1 << 20)).option("parquet.page.row.count.limit", 1000).option("parquet.block.size.row.check.min", 100).parquet(path)
    return n


def _observation():
    from pyspark.sql import Observation

    return Observation(f"rows-{uuid.uuid4().hex}")


def uploaded(files: DataFrame, base_url: str) -> DataFrame:
    """(asset, name, url) of files that would be uploaded; missing and empty ones have no URL."""
    url = F.concat_ws("/", F.lit(base_url), "asset", "name")
    return files.select("asset", "name", F.when(F.col("length") > 0, url).alias("url"))
