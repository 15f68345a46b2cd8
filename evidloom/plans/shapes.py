"""Queries through the data sources, over records of changing shape, and by table functions in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.functions import tables, text, variants
from evidloom.operators import sessions as session_rows
from evidloom.plans import copies
from evidloom.sources import folders, writers


def transcript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript files, read through their data source; no file may be bad."""
    path = copies._folder(spark)
    said = copies.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("asset"), F.lit("en").alias("language"), F.lit(9.876).alias("duration"), (F.col("turn") + 0.123).alias("start"), (F.col("turn") + 0.987).alias("end"), F.col("turn").alias("segment_id"), "text")
    writers.save_transcripts(said, path)
    folders.register(spark)
    found = spark.read.format("evidence_transcripts").load(path)
    return found.select("asset", "segment_id", "start", "end", F.md5("text").alias("text_md5"), "fault")


def session_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions in files of lines, read through their data source as at a start."""
    path = copies._folder(spark)
    message = F.struct("turn", "role", F.col("text").alias("message"), F.lit(None).cast("string").alias("timestamp"))
    own = copies.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("all"))
    messages = F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["message"].alias("message"), m["timestamp"].alias("timestamp")))
    status = F.when(F.col("conv_id") % 7 == 0, "FAILED").otherwise("Evaluating")
    writers.save_session_lines(own.select(F.concat(F.lit("CH-"), "conv_id").alias("chat_id"), text.session_name(F.col("all")[0]["message"]).alias("chat_name"), status.alias("status"), messages.alias("messages"), F.size("all").alias("messages_count"), F.lit(0).alias("retry_count")), path)
    folders.register(spark)
    again = session_rows.reset(spark.read.format("evidence_sessions").load(path).filter("fault is null"))
    return again.select("chat_id", "chat_name", "status", "messages_count", F.size("messages").alias("n"), F.col("messages")[0]["role"].alias("first_role"))


def shaped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as feature records, a frame for each line: bare lists where lines are even in number, else under a name.

    Records are parsed once, written as variants and read back in both shapes in one pass.
    """
    path = copies._folder(spark)
    frames = F.transform(F.split("text", "\n"), lambda line, i: F.struct((i / 2).alias("timestamp"), line.alias("content"), (F.length(line) % 2 == 0).alias("need_vlm")))
    made = F.when(F.size(frames) % 2 == 0, F.to_json(frames)).otherwise(F.to_json(F.struct(frames.alias("alignments"))))
    variants.save_records(copies.table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", variants.record(made).alias("record")), path)
    found = variants.frame_records(spark.read.schema("doc_id bigint, record variant").parquet(path))
    return found.select("doc_id", "place", "timestamp", F.md5("content").alias("content_md5"), "need_vlm")


def _spoken(said: str) -> Iterator[tables.Segment]:
    """Stands in for a recogniser: a segment for each line, a tenth of a second for each character."""
    at = 0
    for line in said.split("\n"):
        yield at / 10, (at + len(line)) / 10, line
        at += len(line)


def heard_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is heard in each text, by a lateral join with a table function."""
    tables.register(spark, heard=tables.hearing(_spoken))
    return spark.sql("SELECT doc_id, start, `end`, segment_id, md5(h.text) AS text_md5 FROM {docs} d, LATERAL heard(d.text) h", docs=copies.table(spark, sf_dir, "documents").select("doc_id", "text"))


def turn_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn that is no question with the question before it, by a table function over ordered conversations."""
    tables.register(spark)
    turns = copies.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return spark.sql("SELECT conv_id, turn, asked_turn, md5(question) AS question_md5, md5(answer) AS answer_md5 FROM answers(TABLE({turns}) PARTITION BY conv_id ORDER BY (turn, role, text))", turns=turns)


QUERIES = (transcript_scan, session_scan, shaped_frames, heard_segments, turn_answers)

_LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"
_STRIP = r"regexp_replace(line, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_ASKED = "last_value(CASE WHEN role = 'user' THEN {'turn': turn, 'text': text} END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)"
ORACLE: dict[str, str] = {
    "transcript_scan": f"SELECT *, NULL::VARCHAR AS fault FROM ({copies.ORACLE['transcript_copy']})",
    "session_scan": copies.ORACLE["session_copy"],
    "shaped_frames": f"SELECT doc_id, i::INT AS place, i / 2 AS timestamp, md5(line) AS content_md5, length(line) % 2 = 0 AS need_vlm FROM ({_LINES})",
    "heard_segments": f"SELECT doc_id, coalesce(sum(length(line)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT / 10 AS start, (sum(length(line)) OVER w)::BIGINT / 10 AS \"end\", i::INT AS segment_id, md5({_STRIP}) AS text_md5 FROM ({_LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY i)",
    "turn_answers": f"SELECT conv_id, turn, q.turn AS asked_turn, md5(q.text) AS question_md5, md5(text) AS answer_md5 FROM (SELECT *, {_ASKED} AS q FROM conversations) WHERE role IS DISTINCT FROM 'user'",
}
