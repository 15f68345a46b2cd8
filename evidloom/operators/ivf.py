"""An inverted-file index of the collection's vectors: cells around centroids, of which a search probes the nearest.

Beside its cell a vector may have a code of its residual, a byte for each few components. A search then reads cells
and codes alone, adds up table entries for each row, and scores exactly only the few rows that come out best. What a
code leaves out is known by its length, so an exact search scores every row that its code doesn't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.operators.retrieval import base_scores

#: Cells of the index (a fixed value), and cells that a search probes. Twelve are usual for vectors that form clusters; on
#: vectors that form none they find under two thirds of the ten best, and these many over nine tenths.
CELLS, PROBES = 128, 72
#: Vectors that centroids are fitted on at most; every vector is put into a cell.
FITTED = 200_000


@dataclass(frozen=True)
class Centroids:
    cells: tuple[tuple[float, ...], ...]

    def nearest(self, query: list[float], probes: int) -> list[int]:
        """Cells by inner product with their centroids; a bounded table on the driver."""
        score = np.array(self.cells) @ np.array(query)
        return [int(i) for i in np.argsort(-score, kind="stable")[:probes]]


def indexed(vectors: DataFrame, vector_col: str = "vector", cells: int = CELLS, fitted: int = FITTED, seed: int = 1) -> tuple[Centroids, DataFrame]:
    """Centroids, fitted on a bounded sample, and ``vectors`` with the ``cell`` of each; rows without a vector are left out."""
    own = vectors.filter(F.size(vector_col) > 0).withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
    n = own.count()
    if not n:
        return Centroids(()), vectors.limit(0).withColumn("cell", F.lit(0))
    model = KMeans(k=min(cells, n), seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(own.sample(min(1.0, fitted / n), seed) if n > fitted else own)
    return Centroids(tuple(tuple(map(float, c)) for c in model.clusterCenters())), model.transform(own).drop("_v")


def saved(rows: DataFrame, path: str) -> None:
    """The index as a table with a folder for each cell, so that a search reads only the cells it probes."""
    rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def loaded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def ivf_topk(rows: DataFrame, centroids: Centroids, query: list[float], k: int, probes: int = PROBES) -> DataFrame:
    """The k best by inner product (columns but the vector, and base) among the probed cells; with all cells probed, exactly the best."""
    near = rows.filter(F.col("cell").isin(centroids.nearest(query, probes))) if centroids.cells else rows
    return base_scores(near, query).drop("cell").orderBy(F.desc("base"), "id").limit(k)


#: Components that a byte of a code stands for, entries of its table, rounds that they are fitted in, and rows that a search scores exactly.
WIDTH, ENTRIES, FIT_ROUNDS, RESCORED = 4, 256, 12, 200
#: Share of a score and its bound that rounding may take in an exact search.
SLACK = 1e-9


@dataclass(frozen=True)
class Codes:
    """Centroids of cells, and for each run of ``WIDTH`` components the table of what a byte of a residual's code stands for."""

    cells: np.ndarray
    tables: tuple[np.ndarray, ...]

    def encoded(self, vectors: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each vector is from what its code stands for."""
        rest, out = vectors - self.cells[cell], np.empty((len(vectors), len(self.tables)), np.uint8)
        for j, table in enumerate(self.tables):
            part = rest[:, j * WIDTH : (j + 1) * WIDTH]
            out[:, j] = _nearest(part, table)
            part -= table[out[:, j]]
        return out, np.sqrt((rest * rest).sum(axis=1))

    def scores(self, query: np.ndarray, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Inner products of the query with what the codes stand for."""
        total = (self.cells @ query)[cell]
        for j, table in enumerate(self.tables):
            total = total + (table @ query[j * WIDTH : (j + 1) * WIDTH])[codes[:, j]]
        return total


def _nearest(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), np.int64)
    for lo in range(0, len(rows), 1 << 14):
        part = rows[lo : lo + (1 << 14)]
        out[lo : lo + (1 << 14)] = ((table * table).sum(axis=1) - 2 * part @ table.T).argmin(axis=1)
    return out


def _fitted(rows: np.ndarray, seed: int) -> np.ndarray:
    """At most ``ENTRIES`` entries near to all rows of a bounded sample; entries that nothing is near to stay."""
    distinct = np.unique(rows, axis=0)
    g = np.random.Generator(np.random.PCG64(seed))
    table = distinct[g.permutation(len(distinct))[:ENTRIES]]
    for _ in range(FIT_ROUNDS):
        at = _nearest(rows, table)
        many = np.bincount(at, minlength=len(table))
        sums = np.stack([np.bincount(at, rows[:, d], len(table)) for d in range(rows.shape[1])], axis=1)
        table = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], table)
    return table


def coded(vectors: DataFrame, cells: int = CELLS, fitted: int = FITTED, seed: int = 1) -> tuple[Codes | None, DataFrame]:
    """``vectors`` (id, vector) with ``cell``, ``code`` and its ``error``, and what they are read by; None for the empty table.

    Centroids and tables are fitted on a sample of about ``fitted`` rows; every vector of the first one's length, a
    multiple of ``WIDTH``, gets a code. Other rows are left out, as are those without a vector.
    """
    centroids, rows = indexed(vectors, cells=cells, fitted=fitted, seed=seed)
    if not centroids.cells:
        return None, _with_codes(rows)
    dim, n = len(centroids.cells[0]), rows.count()
    rows = rows.filter((F.size("vector") == dim) & (F.lit(dim % WIDTH) == 0))
    sample = rows.select("vector", "cell") if n <= fitted else rows.select("vector", "cell").sample(fitted / n, seed)
    found, middle = sample.toArrow(), np.array(centroids.cells)
    x = found.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    rest = x - middle[found.column(1).to_numpy()]
    codes = Codes(middle, tuple(_fitted(rest[:, lo : lo + WIDTH], seed) for lo in range(0, dim, WIDTH)))
    known = vectors.sparkSession.sparkContext.broadcast(codes)
    at, cell_at = rows.columns.index("vector"), rows.columns.index("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            code, error = known.value.encoded(v, batch.column(cell_at).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], [*batch.schema.names, "code", "error"])

    return codes, rows.mapInArrow(run, _with_codes(rows).schema)


def _with_codes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")})


def _near(codes: Codes, query: np.ndarray, code: pa.Array, cell: pa.Array) -> np.ndarray:
    return codes.scores(query, np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), -1), cell.to_numpy())


def coded_topk(rows: DataFrame, codes: Codes | None, query: list[float], k: int, probes: int = CELLS, rescored: int = RESCORED, exact: bool = False) -> DataFrame:
    """The k best by inner product (columns but the vector, and base) among ``rescored`` rows that their codes choose.

    ``rows`` is what ``coded`` gives, best written by ``saved``. Codes are read in the ``probes`` cells whose centroids
    are best; no other cell's folder is, and of these no vector but those of the chosen ids. Each task keeps
    ``rescored`` rows at most. Ties go to the smaller id.

    ``exact`` gives the k best of all ``rows``, whatever ``probes``: the chosen ones only set a score that must be
    reached, and in a second pass every row is scored whose code and error let it.
    """
    if codes is None:
        return base_scores(rows, query).drop("cell", "code", "error").limit(0)
    known, q = rows.sparkSession.sparkContext.broadcast(codes), np.array(query, float)
    chosen = rows.filter(F.col("cell").isin(Centroids(tuple(map(tuple, codes.cells))).nearest(query, probes))).select("id", "cell", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, near = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            ids = np.append(ids, batch.column(0).to_numpy())
            near = np.append(near, _near(known.value, q, batch.column(2), batch.column(1)))
            best = np.lexsort((ids, -near))[:rescored]
            ids, near = ids[best], near[best]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near)], ["id", "near"])

    found = chosen.mapInArrow(run, "id bigint, near double").orderBy(F.desc("near"), "id").limit(rescored).collect()
    best = base_scores(rows.filter(F.col("id").isin([r.id for r in found])), query).drop("cell", "code", "error").orderBy(F.desc("base"), "id").limit(k)
    if not exact:
        return best
    reached = [r.base for r in best.select("base").collect()]
    if len(reached) < k:
        return base_scores(rows, query).drop("cell", "code", "error").orderBy(F.desc("base"), "id").limit(k)
    # Sums in another order differ by far less than the slack.
    least, length = min(reached), float(np.sqrt(q @ q))
    code, cell, error = (rows.columns.index(c) for c in ("code", "cell", "error"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = _near(known.value, q, batch.column(code), batch.column(cell)), length * batch.column(error).to_numpy()
            yield batch.filter(pa.array(~(near + far + SLACK * (1 + np.abs(near) + far) < least)))

    return base_scores(rows.mapInArrow(within, rows.schema), query).drop("cell", "code", "error").orderBy(F.desc("base"), "id").limit(k)
