"""A question's course: search, judge, search again at most once more, then strengthen and answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidloom.operators.backends import rendered
from evidloom.operators.retrieval import accumulated

#: Fixed value: searches for one question.
ATTEMPTS = 2
#: Columns of a hit as ``retrieval.evidence`` gives them.
HIT = "score double, base_vector_score double, content string, metadata struct<asset_name:string,modality:string,type:string,bbox:string,timestamp:double,page_label:int>"
Search = Callable[[int], DataFrame]
Judge = Callable[[DataFrame], str]


def searched(search: Search, judge: Judge, attempts: int = ATTEMPTS) -> tuple[DataFrame, list[str]]:
    """Evidence of all attempts, newest first, repeated rows included, and the states passed; stops once the judge says proceed.

    An attempt's hits are at most k rows, taken once, ranked in their order. A search that fails counts as one without
    hits, in the columns of the ones that didn't; a judge that fails ends in FAILED.
    """
    spark, found, states, shape = SparkSession.active(), [], ["Preparing"], None
    for i in range(attempts):
        states.append("Researching")
        try:
            hits = search(i)
            rows, shape = hits.collect(), hits.schema
        except PySparkException:
            rows = []
        hits = spark.createDataFrame(rows, shape or HIT)
        if rows:
            found.append(spark.createDataFrame([(*r, place) for place, r in enumerate(rows)], T.StructType([*shape.fields, T.StructField("rank", T.IntegerType())])))
        states.append("Evaluating")
        try:
            verdict = judge(hits)
        except Exception:
            states.append("FAILED")
            break
        if verdict == "proceed":
            break
    if states[-1] != "FAILED":
        states += ["Strengthening", "Finalizing", "Idle"]
    none = hits.limit(0).withColumns({"rank": F.lit(0), "attempt": F.lit(0)})
    return accumulated(found) if found else none, states


def prompt(history: DataFrame, evidence: DataFrame, template: str, key: str = "conv_id") -> DataFrame:
    """One prompt for each conversation from its history and evidence texts (key, content, attempt, rank), newest first."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("attempt")).alias("a"), "rank", "content"))), lambda e: e["content"])
    said = evidence.groupBy(key).agg(F.array_join(ordered, " ").alias("evidence"))
    return history.join(said, key, "left").select(key, rendered(template, history=F.col("history"), evidence=F.col("evidence")).alias("prompt"))
