"""Approximate nearest neighbours: each shard of the vectors has a robust-pruned graph, and a beam search answers queries in each.

A shard stays where it is: one partition holds its graph, and the queries come after it as a stream, so a task holds
one shard and a batch of queries, and the index moves once whatever the number of queries. Shards grow with the data up
to a size in bytes, and only then their number does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.llm.common import pieces_of, written
from evidloom.llm.pruned_graph import beam_search, build, entry_points, scaled

#: Least number of shards, most bytes of a shard's vectors, and the width of the search beam.
SHARDS, SHARD_BYTES, BEAM = 16, 32 << 20, 160


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero, and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_bytes: int = SHARD_BYTES, shards: int = SHARDS) -> DataFrame:
    """The graphs as a table: (dim, shard, node, embedding, ids, near), one row for each distinct vector of a shard.

    ``ids`` are the ``k + 1`` smallest ids with that vector in that shard: no answer of ``k`` can hold more. Rows
    without an id or a usable vector are left out; a graph holds vectors of one length. There are at least ``shards``
    shards, and as many as keep each to about ``shard_bytes``.
    """
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    narrow = own.schema["embedding"].dataType.simpleString() == "array<float>"
    size = own.agg(F.sum(F.size("embedding").cast("bigint"))).first()[0] or 0
    n = pieces_of(size * (4 if narrow else 8), shard_bytes, shards)
    dealt = own.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("shard"), "vec_id", F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))

    def made(shard: int, dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        distinct, of = np.unique(vectors + 0, axis=0, return_inverse=True)
        by = np.lexsort((ids, of.ravel()))
        cut = np.searchsorted(of.ravel()[by], np.arange(len(distinct) + 1))
        mix = np.random.Generator(np.random.PCG64(5)).permutation(len(distinct))
        near = build(scaled(distinct[mix])[0])
        lists = [ids[by[cut[i] : min(cut[i + 1], cut[i] + k + 1)]] for i in mix.tolist()]
        m = len(mix)
        return pa.RecordBatch.from_arrays([pa.array([dim] * m, pa.int32()), pa.array([shard] * m, pa.int32()), pa.array(np.arange(m), pa.int32()), _lists(distinct[mix]), pa.array(lists, pa.list_(pa.int64())), _lists(near.astype(np.int32))], ["dim", "shard", "node", "embedding", "ids", "near"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for key in set(zip(shard.tolist(), dims.tolist(), strict=True)):
                part = batch.filter(pa.array((shard == key[0]) & (dims == key[1])))
                held.setdefault(key, []).append((part.column(2).to_numpy(), _matrix(part.column(3), key[1])))
        for key in sorted(held):
            ids, rows = zip(*held.pop(key), strict=True)
            yield made(*key, np.concatenate(ids), np.concatenate(rows))

    return dealt.repartitionById(n, "shard").mapInArrow(make, f"dim int, shard int, node int, embedding {'array<float>' if narrow else 'array<double>'}, ids array<bigint>, near array<int>")


class _Shard:
    """A shard's graph, put together from batches of nodes in order."""

    def __init__(self, dim: int):
        self.dim, self.parts = dim, []

    def add(self, rows: pa.RecordBatch) -> None:
        self.parts.append((_matrix(rows.column("embedding"), self.dim), rows.column("near").flatten().to_numpy().reshape(rows.num_rows, -1), rows.column("ids")))

    def answer(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> pa.RecordBatch:
        if len(self.parts) > 1 or not hasattr(self, "exact"):
            exact, near, lists = zip(*self.parts, strict=True)
            self.exact, self.near, self.ids = np.concatenate(exact), np.concatenate(near), pa.concat_arrays(lists)
            self.vectors, self.by = scaled(self.exact)
            self.parts = [(self.exact, self.near, self.ids)]
            self.offsets, self.flat = self.ids.offsets.to_numpy(), self.ids.values.to_numpy()
        small = queries / queries.dtype.type(self.by)
        found, _ = beam_search(self.vectors, self.near, small, entry_points(len(self.vectors), beam), beam)
        out: list[list] = [[], [], []]
        for i, own in enumerate(ids.tolist()):
            at = found[i][found[i] >= 0]
            apart = (self.exact[at].astype(np.float64) - queries[i].astype(np.float64)) / self.by
            d = (np.sqrt((apart**2).sum(axis=1)) * self.by).tolist()
            best = sorted((s, x) for s, j in zip(d, at.tolist(), strict=True) for x in self.flat[self.offsets[j] : self.offsets[j + 1]].tolist() if x != own)[:k]
            for column, x in zip(out, ([own] * len(best), [x for _, x in best], [s for s, _ in best]), strict=True):
                column += x
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])


def search(graphs: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, beam: int = BEAM) -> DataFrame:
    """Each query's ``k`` nearest found: (query_id, rank, vec_id, score), ties to the smaller id.

    ``graphs`` is a written index. ``score`` is the Euclidean distance in double precision. A vector with the query's
    id is never its answer. Of queries that share an id, the one whose vector comes first in order asks. Queries
    without an id or a usable vector ask nothing.
    """
    asked = queries.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vector_col).alias("q")).filter(F.col("query_id").isNotNull() & usable(F.col("q")))
    narrow = {graphs.schema["embedding"].dataType.simpleString(), asked.schema["q"].dataType.simpleString()} == {"array<float>"}
    kind = "array<float>" if narrow else "array<double>"
    asked = written(asked.groupBy("query_id").agg(F.min("q").alias("q")))
    n = (graphs.agg(F.max("shard")).first()[0] or 0) + 1
    held = graphs.select("dim", "shard", F.lit(None).cast("bigint").alias("query_id"), "node", F.col("embedding").cast(kind).alias("embedding"), "ids", "near")
    # The stated queries go to every shard; there they come after the nodes.
    sent = asked.select(F.size("q").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), "query_id", F.col("q").cast(kind).alias("embedding"))
    together = held.unionByName(sent, allowMissingColumns=True).repartitionById(n, "shard").sortWithinPartitions("shard", "dim", F.col("query_id").asc_nulls_first(), "node")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            marks = np.column_stack([batch.column(1).to_numpy(), batch.column(0).to_numpy(), batch.column("query_id").is_valid().to_numpy(zero_copy_only=False)])
            cut = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                key, part = tuple(marks[lo, :2].tolist()), batch.slice(lo, hi - lo)
                if not marks[lo, 2]:
                    if key != now:
                        now, shard = key, _Shard(key[1])
                    shard.add(part)
                elif key == now:  # a shard may have no vector of that length
                    yield shard.answer(part.column("query_id").to_numpy(), _matrix(part.column("embedding"), key[1]), k, beam)

    found = together.mapInArrow(answer, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
