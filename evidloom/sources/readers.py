"""Readers with fixed schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidloom.functions.text import asset_type, file_name, first_full, frame_seconds
from evidloom.operators.collection import COLLECTION
from evidloom.operators.flatten import PARSED

ASSET = "asset_id string, asset_type string, status string, asset_raw_path string, asset_processed_path string, created_at string, retry_count int"
MESSAGE = "array<struct<role:string,message:string,timestamp:string>>"
EVIDENCE = "array<struct<score:double,base_vector_score:double,content:string,metadata:struct<asset_name:string,modality:string,type:string,bbox:string,timestamp:double,page_label:int>>>"
SESSION = f"chat_id string, chat_name string, status string, messages {MESSAGE}, evidence {EVIDENCE}, messages_count int, evidence_count int, retry_count int, uptime string, last_active string"
TRANSCRIPT = "asset_id string, language string, duration double, segments array<struct<start:double,end:double,text:string>>"
_IMAGE = "struct<type:string,page_idx:int,text_slice:string,embedding:array<float>,bbox:array<double>>"
DOCUMENT_FEATURES = f"images map<string,{_IMAGE}>, text_chunks array<{_IMAGE}>"
_FRAME = "struct<timestamp:double,frame_name:string,img_vector:array<float>,text_vector:array<float>,content:string,need_vlm:boolean>"
_POINT = "struct<heading:string,anchor:double,summary:string>"
OUTLINE = f"asset_id string, generated_at string, outline struct<title:string,outline:array<struct<heading:string,anchor:double,summary:string,sub_points:array<{_POINT}>>>>"

#: The eight states of an asset and the seven of a session; the literal values are fixed.
ASSET_STATES = ("Uploading", "Raw", "recognizing", "Cliping", "Structuring", "Ingesting", "Ready", "Failed")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files that are taken: name, type and length; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.withColumn("asset_id", file_name(F.col("path"))).withColumn("asset_type", asset_type(F.col("asset_id"))).filter("asset_type is not null")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One row for each asset of a registry file, bare or under ``assets_map``; missing fields get their defaults."""
    entry = ", ".join(f"{n}:{t}" for n, t in (c.split() for c in ASSET.split(", ")))
    kind = f"map<string,struct<{entry}>>"
    text = spark.read.text(path, wholetext=True)
    inner = F.get_json_object("value", "$.assets_map")
    rows = text.select(F.explode(F.from_json(F.coalesce(inner, F.col("value")), kind)).alias("key", "a"))
    return rows.select(
        F.coalesce("a.asset_id", "key").alias("asset_id"), "a.asset_type", F.coalesce("a.status", F.lit("Raw")).alias("status"),
        "a.asset_raw_path", "a.asset_processed_path", "a.created_at", F.coalesce("a.retry_count", F.lit(0)).alias("retry_count"),
    )


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each session file; files that can't be read are left out."""
    rows = spark.read.schema(f"{SESSION}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record is null and chat_id is not null").drop("_corrupt_record")


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line of files of sessions; lines that can't be read are left out."""
    rows = spark.read.schema(f"{SESSION}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record is null and chat_id is not null").drop("_corrupt_record")


def session_messages(found: DataFrame) -> DataFrame:
    return found.select("chat_id", F.posexplode("messages").alias("turn", "m")).select("chat_id", "turn", "m.*")


def parsed_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(asset, and the parsed tree); of an asset's several files the one under the first path counts, then by name."""
    out = None
    for i, path in enumerate(paths):
        rows = spark.read.schema(PARSED).option("multiLine", True).option("recursiveFileLookup", "true").json(path)
        rows = rows.withColumn("file", F.input_file_name()).withColumn("place", F.lit(i)).withColumn("asset", F.regexp_replace(file_name(F.col("file")), r"(_middle)?\.json$", ""))
        out = rows if out is None else out.unionByName(rows)
    best = Window.partitionBy("asset").orderBy("place", "file")
    return out.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "place", "file")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(asset, start, end, segment_id, text), one row for each segment."""
    rows = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("recursiveFileLookup", "true").json(path)
    return rows.select(F.col("asset_id").alias("asset"), F.posexplode("segments").alias("segment_id", "s")).select("asset", "s.start", "s.end", "segment_id", "s.text")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """(asset, ts, frame_id, path) of frame files; the asset is the folder. Names without a time are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jpg").load(path).select("path", "length")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("asset"), frame_seconds(F.col("path")).alias("ts"), file_name(F.col("path")).alias("frame_id"), "path").filter("ts is not null")


def _folder(path: Column) -> Column:
    """The asset that a file's folder is named after, as such or as ``asset=...``."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -2)), "^asset=", "")


def document_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Images and text chunks of feature files, with the folder as asset."""
    rows = spark.read.schema(DOCUMENT_FEATURES).option("multiLine", True).option("recursiveFileLookup", "true").json(path).withColumn("asset", _folder(F.input_file_name()))
    pictures = rows.select("asset", F.explode("images").alias("name", "i")).select("asset", "name", "i.page_idx", "i.text_slice", "i.bbox", F.col("i.embedding").alias("vector"))
    return pictures, rows.select("asset", F.explode("text_chunks").alias("c")).select("asset", "c.page_idx", "c.text_slice", "c.bbox", F.col("c.embedding").alias("vector"))


def video_features(spark: SparkSession, path: str) -> DataFrame:
    """Frame records of feature files, an array or the same under ``alignments``, with the folder as asset."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("asset", _folder(F.input_file_name()))
    bare = F.from_json("value", f"array<{_FRAME}>")
    under = F.from_json(F.get_json_object("value", "$.alignments"), f"array<{_FRAME}>")
    return text.select("asset", F.explode(first_full(under, bare)).alias("f")).filter("f.timestamp is not null").select("asset", "f.*")


def content_lists(spark: SparkSession, path: str) -> DataFrame:
    """(asset, content): content lists of parsed documents as they stand in files named after the asset."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_content_list.json")
    return rows.select(F.regexp_replace(file_name(F.input_file_name()), r"_content_list\.json$", "").alias("asset"), F.col("value").alias("content"))


def outlines(spark: SparkSession, path: str) -> DataFrame:
    """(asset_id, title, place, heading, anchor, summary, sub_points), one row for each heading."""
    rows = spark.read.schema(OUTLINE).option("multiLine", True).json(path)
    return rows.select("asset_id", F.col("outline.title").alias("title"), F.posexplode("outline.outline").alias("place", "o")).select("asset_id", "title", "place", "o.*")


def collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLLECTION).parquet(path)
