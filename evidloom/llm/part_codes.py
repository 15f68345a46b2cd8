"""Vector code compression: product codes from Lloyd's rounds over distinct integer parts.

Vectors become integers and are cut into equal parts. Equal parts of one position are counted into one weighted row, and
the rounds run over these rows: each task assigns its rows to the codebook's entries and sends one sum for each entry
that it met. Codes and errors then go back to the vectors by a join on the parts. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components beyond this, once scaled, are taken for not finite: squares of differences must stay within 64 bits.
LARGEST = 1 << 27
#: Up to this size of components a matrix product in double precision is exact for parts of up to 512 components.
EXACT = 1 << 21
#: Numbers of a distance table that a task makes at a time.
TABLE = 1 << 21
WIDTHS = (np.int16, np.int32)


@dataclass(frozen=True)
class Codebooks:
    """``entries`` has for each part position an (entries, width) array of integers; ``scale`` makes integers of components."""

    entries: tuple[np.ndarray, ...]
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries[0].shape[1] if self.entries else 0

    def sha256(self) -> str:
        """Hex digest of all components as decimal text, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector is there and all its components are finite numbers, small enough for exact arithmetic."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * float(scale) > float(LARGEST)))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _packed(rows: np.ndarray) -> list[bytes]:
    """Each row of integers in as few bytes as it needs, so that equal rows are equal bytes."""
    narrow = np.abs(rows).max(axis=1, initial=0) < 1 << 15
    small, wide = rows.astype("<i2"), rows.astype("<i4")
    return [small[i].tobytes() if n else wide[i].tobytes() for i, n in enumerate(narrow.tolist())]


def _unpacked(keys: pa.Array, width: int) -> np.ndarray:
    """The integers behind packed rows; a null (of an empty part) never comes here."""
    sizes = pc.binary_length(keys).to_numpy(zero_copy_only=False)
    if (sizes == 2 * width).all():
        return np.frombuffer(b"".join(keys.to_pylist()), "<i2").reshape(-1, width).astype(np.int64)
    return np.array([np.frombuffer(k, "<i2" if len(k) == 2 * width else "<i4") for k in keys.to_pylist()], np.int64).reshape(-1, width)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry, ties to the lower index, and the squared distance to it; in exact integers."""
    index, error = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    quick = max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)) < EXACT and rows.shape[1] <= 512
    step = max(1, TABLE // (len(entries) * (1 if quick else rows.shape[1])))
    e = entries.astype(np.float64)
    squares = (e * e).sum(axis=1)
    for lo in range(0, len(rows), step):
        part = rows[lo : lo + step]
        if quick:
            p = part.astype(np.float64)
            d = squares - 2 * (p @ e.T)
            at = d.argmin(axis=1)
            found = d[np.arange(len(part)), at] + (p * p).sum(axis=1)
        else:
            d = ((part[:, None, :] - entries) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            found = d[np.arange(len(part)), at]
        index[lo : lo + step], error[lo : lo + step] = at, found
    return index, error


def cut(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Vectors as packed integer parts: (row, id, the columns of ``keep``, keys), written, and the length of vectors.

    Left out are null vectors, those with a component that is null, not finite or beyond ``LARGEST / scale``, and those
    whose length isn't that of the vector with the smallest id, or isn't a multiple of ``parts``.
    """
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), *(F.col(c) for c in keep), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v"), scale) & (F.size("v") % parts == 0) & (F.size("v") > 0))
    first = own.agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v")).alias("first")).select(F.size("first.v")).first()[0] or 0
    dim = max(first, 0)
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            whole = np.floor(x * scale).astype(np.int64)
            keys = _packed(whole.reshape(-1, width))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * parts), pa.array(keys, pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*batch.schema.names[:-1], "keys"])

    kept = own.filter(F.size("v") == dim)
    packed = kept.mapInArrow(run, kept.select("*", F.lit(None).cast("array<binary>").alias("keys")).drop("v").schema)
    return written(packed.withColumn("row", F.monotonically_increasing_id())), dim


def weighted(cuts: DataFrame) -> DataFrame:
    """The distinct parts of each position and how many vectors have them: (part, key, weight), written."""
    each = cuts.select(F.posexplode("keys").alias("part", "key"))
    return written(each.groupBy("part", "key").agg(F.count(F.lit(1)).alias("weight")))


def _begun(cuts: DataFrame, parts: int, dim: int, entries: int, scale: int) -> Codebooks:
    """The parts of the vectors with the smallest ids, null last, ties by the parts; a bounded number of rows."""
    rows = cuts.orderBy(F.col("id").asc_nulls_last(), "keys").limit(entries).select("keys").collect()
    width = dim // parts
    books = (_unpacked(pa.array([bytes(r.keys[i]) for r in rows], pa.binary()), width) for i in range(parts)) if rows else ()
    return Codebooks(tuple(books), scale)


def _round(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes the floored mean of the parts nearest to it; entries that no part is nearest to stay."""
    width = books.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            part, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i in np.unique(part).tolist():
                mask = part == i
                x, w = _unpacked(batch.column(1).filter(pa.array(mask)), width), weight[mask]
                at = nearest(x, books.entries[i])[0]
                order = np.argsort(at, kind="stable")
                met, cuts = np.unique(at[order], return_index=True)
                many[i][met] += np.add.reduceat(w[order], cuts)
                total[i][met] += np.add.reduceat(x[order] * w[order, None], cuts, axis=0)
        for i, m in enumerate(many):
            met = np.flatnonzero(m)
            flat = pa.array(total[i][met].ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(met), pa.int32()), pa.array(met, pa.int32()), pa.array(m[met]), lists], ["part", "entry", "many", "total"])

    partial = rows.select("part", "key", "weight").mapInArrow(sums, "part int, entry int, many bigint, total array<bigint>")
    found = partial.groupBy("part", "entry").agg(F.sum("many").alias("many"), F.array(*(F.sum(F.col("total")[i]) for i in range(width))).alias("total")).collect()
    moved = [e.copy() for e in books.entries]
    for r in found:
        moved[r.part][r.entry] = [t // r.many for t in r.total]
    return Codebooks(tuple(moved), books.scale)


def fit(cuts: DataFrame, distinct: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after ``rounds`` of weighted Lloyd over the distinct parts; only their entries come to the driver."""
    books = _begun(cuts, parts, dim, entries, scale)
    for _ in range(rounds if books.entries else 0):
        books = _round(distinct, books)
    return books


def encoded(cuts: DataFrame, distinct: DataFrame, books: Codebooks, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of ``keep``, code, error): the part codes in hex joined back to each vector of ``cuts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            code, error = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
            for i in np.unique(part).tolist():
                mask = part == i
                code[mask], error[mask] = nearest(_unpacked(batch.column(1).filter(pa.array(mask)), books.width), books.entries[i])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["part", "key", "code", "error"])

    told = distinct.select("part", "key").mapInArrow(run, "part int, key binary, code int, error bigint")
    each = cuts.select("row", F.posexplode("keys").alias("part", "key")).join(told, ["part", "key"]).select("row", "part", "code", "error")
    digits = max(2, len(f"{max((len(e) for e in books.entries), default=1) - 1:x}"))
    own = cuts.select("row", "id", *keep)
    # One row of each vector has what is kept of it, its others a code each; so hot parts are split, and nothing is joined by id.
    rows = each.unionByName(own, allowMissingColumns=True)
    hexed = F.lpad(F.lower(F.hex("code")), digits, "0")
    found = rows.groupBy("row").agg(
        F.max("id").alias("id"), *(F.max(c).alias(c) for c in keep),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("part", hexed.alias("code"))))), lambda x: x["code"]), "").alias("code"),
        F.sum("error").alias("error"),
    )
    return found.drop("row")


def decoded(codes: DataFrame, books: Codebooks, code_col: str = "code", name: str = "vector") -> DataFrame:
    """``codes`` with the vectors that their codes stand for, in the middle of each step of the integers."""
    digits = max(2, len(f"{max((len(e) for e in books.entries), default=1) - 1:x}"))
    tables = F.array(*(F.array(*(F.array(*(F.lit((x + 0.5) / books.scale) for x in row)) for row in e.tolist())) for e in books.entries))
    at = lambda i: F.conv(F.substring(code_col, 1 + digits * i, digits), 16, 10).cast("int")
    return codes.withColumn(name, F.flatten(F.array(*(tables[i][at(i)] for i in range(len(books.entries))))))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable vectors, (vec_id, code, error, label_error), and the codebooks.

    Each component x is floor(scale * x); the codebook of each part starts as that part of the ``entries`` smallest ids
    (null ids last, ties by the integers in packed form), fewer where there are fewer vectors. ``error`` is a vector's
    squared distance to what its code stands for, ``label_error`` that of all vectors with its label, nulls together;
    null should the sum not fit 64 bits. Repeated rows have a row each, equal vectors equal codes; the empty table has
    no code and no codebook. What ``cut`` leaves out has no row. Other columns are left out.
    """
    own = vectors.withColumn("_label", F.col(label_col) if label_col else F.lit(None).cast("int"))
    cuts, dim = cut(own.select(F.col(id_col).alias("_id"), F.col("_label"), F.col(vector_col).alias("_v")), "_id", "_v", ("_label",), parts, scale)
    distinct = weighted(cuts)
    books = fit(cuts, distinct, dim, parts, entries, rounds, scale)
    codes = written(encoded(cuts, distinct, books, ("_label",)))
    discard(cuts, distinct)
    sums = codes.groupBy(F.col("_label").alias("_of")).agg(F.try_sum("error").alias("label_error"))
    return codes.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error"), books


_PARTS = f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, i AS part, v[i * len(v) // 4 + 1 : (i + 1) * len(v) // 4] AS x FROM kept, range(4) t(i)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 256)"""


def _assigned(k: int) -> str:
    """The nearest entry of each part under the codebooks of round k."""
    d = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"a{k} AS MATERIALIZED (SELECT r, p.part, first(p.x) AS x, min({{'d': {d}, 'e': entry}}) AS m FROM p JOIN b{k} b ON b.part = p.part GROUP BY r, p.part)"


def _moved(k: int) -> str:
    """The codebooks of round k + 1: floored means, component by component; integer division rounds down by hand."""
    return f"""s{k} AS (SELECT part, m.e AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS c FROM a{k}, range(1, 1025) t(i) WHERE i <= len(x) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(CASE WHEN s % c < 0 THEN s // c - 1 ELSE s // c END ORDER BY i) AS x FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""


ORACLE = f"""
WITH {_PARTS}, {", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(4))}, {_assigned(4)},
codes AS MATERIALIZED (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a4 GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (r), sha
"""
