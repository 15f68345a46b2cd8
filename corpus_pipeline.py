"""Corpus pipeline: stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm import bpe_codec, jaccard_join, mixing, secrets, toxicity
from evidloom.llm.common import fresh, small_batches, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, doesn't reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    name = fresh(docs, "toxicity")
    return toxicity.score(docs, model, name=name).filter(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, and all that are alone."""
    return jaccard_join.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kinds and ``n_chars`` counted anew."""
    name = fresh(docs, "secrets")
    return secrets.scan(docs, redact=True, name=name).drop(name).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, dealt into shards and shuffled there."""
    mix = mixing.mixed(docs)
    shard, place = mix.columns[-2:]
    return mixing.shuffled(mix, shard, place).drop(shard, place)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the hashes of a round trip."""
    return bpe_codec.encode_documents(docs)


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose Python workers get little text at a time; they live from stage to stage, and so does what they took."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("n-gram Jaccard join", in_small_batches(drop_near_duplicates)),
    ("secret scans", in_small_batches(redact_secrets)),
    ("mixing sources to target weights", in_small_batches(mix_sources)),
    ("byte-level BPE encoding and decoding", in_small_batches(encode)),
]
#: No single statement expresses the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
