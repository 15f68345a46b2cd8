"""Records inside text: what workers, models and streams print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_line(c: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(c, r"\s+$", ""), "\n"), -1)


def last_line_record(c: Column, schema: str) -> Column:
    """The last line as JSON, and ``status``: success, or partial_success where it isn't JSON."""
    parsed = F.from_json(last_line(c), schema)
    sound = F.get_json_object(last_line(c), "$").isNotNull() & F.startswith(F.ltrim(last_line(c)), F.lit("{"))
    return F.struct(F.when(sound, "success").otherwise("partial_success").alias("status"), F.when(sound, parsed).alias("data"))


def piped(c: Column) -> Column:
    """``SUCCESS|key:value|...`` as a map; a value ends at its next colon; null for other lines."""
    pairs = F.transform(F.filter(F.split(c, r"\|"), lambda p, i: i > 0), lambda p: F.split(p, ":"))
    keyed = F.filter(pairs, lambda p: F.size(p) > 1)
    return F.when(F.startswith(c, F.lit("SUCCESS|")), F.map_from_entries(F.transform(keyed, lambda p: F.struct(p[0], p[1]))))


def between(c: Column, begin: str, end: str) -> Column:
    """What stands between the first begin mark and the next end mark, over lines; null without both."""
    rest = F.substring_index(c, begin, -1) if begin == end else F.split_part(c, F.lit(begin), F.lit(2))
    return F.when(F.contains(c, F.lit(begin)) & F.contains(rest, F.lit(end)), F.split_part(rest, F.lit(end), F.lit(1)))


def deltas(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Pieces of text in order from a model's event stream: ``data: `` lines until ``[DONE]``, other lines left out."""
    said = lines.filter(F.startswith(F.col(line), F.lit("data: "))).withColumn("payload", F.substring(line, 7, 1 << 30))
    end = said.filter("payload = '[DONE]'").groupBy(F.col(key).alias("end_key")).agg(F.min(order).alias("end"))
    open_ = said.join(end, F.col(key).eqNullSafe(F.col("end_key")), "left").filter(F.col("end").isNull() | (F.col(order) < F.col("end")))
    return open_.select(key, order, F.get_json_object("payload", "$.choices[0].delta.content").alias("delta")).filter("delta is not null")
