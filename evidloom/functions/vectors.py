"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums that a task holds at most.
HELD = 1 << 22


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if a vector is null or the lengths differ."""
    summed = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), summed)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v: Column, least: float = 1e-6) -> Column:
    """The vector over its length; as it is where the length is at most ``least``."""
    return F.transform(F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n"))), lambda s: F.when(s["n"] > least, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"]))[0]


def mean_abs_difference(a: Column, b: Column, scale: float = 255.0) -> Column:
    """How much two equally long arrays of levels differ, from 0 to 1; null for empty ones."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a) / scale)


def mean_pooled(rows: DataFrame, key: str, vector: str, name: str = "mean") -> DataFrame:
    """The element-wise mean of each key's vectors, as (key, position, mean) rows.

    Each task adds its vectors up and sends one row of sums for each key, so no component is ever a row of its own
    before keys meet. Null vectors and null components don't count; a position where all are null has a null mean.
    Vectors may differ in length. A task holds at most ``HELD`` sums before it sends them.
    """
    own = rows.select(key, F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    kind = own.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            keys, sizes = batch.column(0).to_pylist(), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten()
            x, there, ends = flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            x = np.where(there, x, 0.0)
            for k, hi, n in zip(keys, ends.tolist(), sizes.tolist(), strict=True):
                total = held.get((k, n))
                if total is None:
                    total = held[k, n] = [np.zeros(n), np.zeros(n, np.int64)]
                total[0] += x[hi - n : hi]
                total[1] += there[hi - n : hi]
            if sum(n for _, n in held) > HELD:
                yield _sums(held, batch.schema.field(0).type)
                held = {}
        if held:
            yield _sums(held, batch.schema.field(0).type)

    partial = own.mapInArrow(run, f"{key} {kind}, total array<double>, many array<bigint>")
    each = partial.repartition(key).select(key, F.posexplode(F.arrays_zip("total", "many")).alias("position", "s"))
    added = each.groupBy(key, "position").agg(F.sum("s.total").alias("total"), F.sum("s.many").alias("many"))
    return added.select(key, "position", F.when(F.col("many") > 0, F.col("total") / F.col("many")).alias(name))


def _sums(held: dict[tuple, list], kind: pa.DataType) -> pa.RecordBatch:
    """The held sums as rows; a row stands for a key and a length of vectors."""
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], kind), pa.array([t for t, _ in held.values()], pa.list_(pa.float64())), pa.array([m for _, m in held.values()], pa.list_(pa.int64()))], ["key", "total", "many"])


def collected(pooled: DataFrame, key: str, name: str = "mean") -> DataFrame:
    """(key, position, value) rows as one array for each key; its length is the vectors' dimension."""
    return pooled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", name))), lambda s: s[name]).alias(name))
