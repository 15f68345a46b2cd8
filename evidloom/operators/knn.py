"""Nearest neighbours of many questions at once: an exact join by blocks of vectors.

The vectors stay where they are. Each task takes its vectors as blocks, scores a block against all questions with one
matrix product, and keeps the best few of each question; these bounded lists are merged in two steps. The product says
which rows can be among the best; those are scored again in the order of the components, so scores don't depend on how
a product is summed and equal those of ``retrieval.base_scores``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.sources.stored import stored

#: Bytes of questions that every task gets at once; more questions are asked in several passes over the vectors.
QUESTION_BYTES = 32 << 20
#: Scores that a task makes at a time, and lists that the first step of the merge leaves of each question.
TABLE, FAN = 1 << 22, 64


def usable(vector: Column, dim: int | None = None) -> Column:
    """Whether a vector is there, of length ``dim`` if that is given, and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = vector.isNotNull() & ~F.coalesce(odd, F.lit(True))
    return fit & (F.size(vector) == dim) if dim is not None else fit


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Best:
    """The best ``limit`` rows of each question so far: by score, ties to the smaller id."""

    def __init__(self, questions: np.ndarray, limit: int):
        self.q, self.limit, self.length = questions, limit, np.linalg.norm(questions, axis=1)
        self.of, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.bar = np.full(len(questions), -np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        table = self.q @ rows.T
        bar = self.bar
        if len(rows) > self.limit:
            bar = np.maximum(bar, np.partition(table, len(rows) - self.limit, axis=1)[:, len(rows) - self.limit])
        # Two ways of summing differ by less than this.
        slack = 8 * rows.shape[1] * np.finfo(float).eps * self.length * np.linalg.norm(rows, axis=1).max(initial=0)
        of, at = np.nonzero(table >= (bar - slack)[:, None])
        step = max(1, TABLE // rows.shape[1])
        scores = [in_order(self.q[of[lo : lo + step]], rows[at[lo : lo + step]]) for lo in range(0, len(of), step)]
        of, ids, scores = np.concatenate([self.of, of]), np.concatenate([self.ids, ids[at]]), np.concatenate([self.scores, *scores])
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        begin = np.searchsorted(of, np.arange(len(self.q)))
        kept = np.arange(len(of)) - begin[of] < self.limit
        self.of, self.ids, self.scores = of[kept], ids[kept], scores[kept]
        full = np.flatnonzero(np.bincount(self.of, minlength=len(self.q)) == self.limit)
        last = np.searchsorted(self.of, full, side="right") - 1
        self.bar[full] = self.scores[last]


def _pass(vectors: DataFrame, questions: pa.Table, limit: int, dim: int) -> DataFrame:
    """The best of each question in each task: (question_id, id, base, slot)."""
    known = vectors.sparkSession.sparkContext.broadcast((questions.column(0).to_numpy(), _matrix(questions.column(1).combine_chunks(), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = known.value
        best, step = Best(asked, limit), max(1, TABLE // max(len(asked), dim))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                best.add(part.column(0).to_numpy(), _matrix(part.column(1), dim))
        slot = pa.array([TaskContext.get().partitionId() % FAN] * len(best.of), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(names[best.of], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.scores), slot], ["question_id", "id", "base", "slot"])

    return vectors.mapInArrow(run, "question_id bigint, id bigint, base double, slot int")


def nearest(vectors: DataFrame, questions: DataFrame, limit: int, vector_col: str = "vector", question_bytes: int = QUESTION_BYTES) -> DataFrame:
    """(question_id, id, base, place): the ``limit`` rows of ``vectors`` with the largest inner product with each question.

    Exact, ties to the smaller id. ``vectors`` has id and a vector, ``questions`` question_id and a vector of the same
    name. Of questions that share an id the one whose vector comes first in order asks. Rows and questions without an
    id, and with a vector that is null, holds a component that is null or not finite, or is of another length than the
    question with the smallest id, take no part. Other columns are left out. Only a bounded number of questions is
    sent to tasks at once; beyond it the vectors are read again for each such number.
    """
    v = F.col(vector_col)
    asked = questions.select(F.col("question_id").cast("bigint").alias("question_id"), v.cast("array<double>").alias("q")).filter(F.col("question_id").isNotNull() & usable(F.col("q")) & (F.size("q") > 0))
    asked = stored(asked.groupBy("question_id").agg(F.min("q").alias("q")))
    size = asked.agg(F.min_by(F.size("q"), "question_id").alias("dim"), F.count(F.lit(1)).alias("n")).first()
    spark = vectors.sparkSession
    if not size.n:
        return spark.createDataFrame([], "question_id bigint, id bigint, base double, place int")
    passes = -(-size.n * size.dim * 8 // question_bytes)
    own = vectors.select(F.col("id").cast("bigint").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector"), size.dim))
    found = None
    for i in range(passes):
        part = asked.filter((F.size("q") == size.dim) & (F.pmod(F.xxhash64("question_id"), F.lit(passes)) == i)).toArrow()
        if part.num_rows:
            rows = _pass(own, part, limit, size.dim)
            found = rows if found is None else found.unionByName(rows)
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("base"), "id"))
    some = found.withColumn("place", best("question_id", "slot")).filter(F.col("place") <= limit)
    return some.withColumn("place", best("question_id")).filter(F.col("place") <= limit).drop("slot")
