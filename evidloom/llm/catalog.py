"""The training-data queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm import chat_format, fill_middle, jaccard_join, lsh_forest, mixing, nearest, part_codes, quality_rules, secrets, suffix_dedup, toxicity
from evidloom.llm.bpe_codec import encode_documents
from evidloom.llm.common import table, written
from evidloom.llm.token_counts import count_tokens


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.perspectives(table(spark, sf_dir, "conversations"))
    return rows.withColumn("mask", chat_format.listed(F.col("mask")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), model, name="score")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(written(nearest.index(vectors)), vectors.filter(F.col("vec_id") % 100 == 0))


def op11_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.rearranged(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = part_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.withColumn("codebooks_sha256", F.lit(books.sha256()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": suffix_dedup.ORACLE,
        "op2_quality_rules": quality_rules.ORACLE,
        "op4_secret_scan": secrets.ORACLE,
        "op5_jaccard_join": jaccard_join.ORACLE,
        "op6_chat_format": chat_format.ORACLE,
        "op11_near_dedup": lsh_forest.ORACLE,
        "op12_fill_middle": fill_middle.ORACLE,
        "op13_part_codes": part_codes.ORACLE,
    }
