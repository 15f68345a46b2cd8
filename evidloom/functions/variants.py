"""Records of changing shape as variants: parsed once, every shape read from the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions.records import last_line


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def record(c: Column) -> Column:
    """Text as a variant; null for what isn't JSON or is over Spark's limit for a variant (128 MB)."""
    return F.try_parse_json(c)


def listed(v: Column, under: str) -> Column:
    """The elements of a record that is an array or holds one under a name; null for any other shape."""
    inner = F.try_variant_get(v, f"$.{under}", "variant")
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(_is(inner, "ARRAY"), F.try_variant_get(inner, "$", "array<variant>"))


def fields(v: Column, schema: dict[str, str]) -> list[Column]:
    """Columns from a variant's fields; a missing field or one of another type is null."""
    return [F.try_variant_get(v, f"$.{name}", kind).alias(name) for name, kind in schema.items()]


def worker_result(c: Column) -> Column:
    """A worker's last line: (status, data), the record as a variant whatever its fields; partial_success if it isn't a record."""
    v = record(last_line(c))
    sound = F.coalesce(_is(v, "OBJECT"), F.lit(False))
    return F.struct(F.when(sound, "success").otherwise("partial_success").alias("status"), F.when(sound, v).alias("data"))


#: The fields of a frame record.
FRAME = {"timestamp": "double", "frame_name": "string", "img_vector": "array<float>", "text_vector": "array<float>", "content": "string", "need_vlm": "boolean"}


def frame_records(rows: DataFrame, record_col: str = "record", under: str = "alignments") -> DataFrame:
    """The other columns, ``place`` (from 0) and the fields of each frame in both shapes of feature records.

    Records of another shape and elements without a time give no row. Vectors are narrowed from doubles.
    """
    keys = [c for c in rows.columns if c != record_col]
    each = rows.select(*keys, F.posexplode(listed(F.col(record_col), under)).alias("place", "frame"))
    return each.select(*keys, "place", *fields(F.col("frame"), FRAME)).filter("timestamp is not null")


def save_records(rows: DataFrame, path: str) -> None:
    """Rows with variant columns as Parquet, common fields in columns of their own (shredded) where the writer finds such."""
    rows.write.option("compression", "zstd").parquet(path)
