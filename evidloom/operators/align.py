"""Interval alignment: each frame with the segments of its asset that overlap a window around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.functions.text import stripped

# Seconds before and after a frame, and the length under which its text asks for a look at the picture.
BEFORE, AFTER = 5.0, 15.0
SHORT = 15


def overlap_pairs(frames: DataFrame, segments: DataFrame, before: float = BEFORE, after: float = AFTER) -> DataFrame:
    """(asset, ts, frame and segment columns) of all overlaps, both ends included, by an equi-join on asset and bin.

    ``frames`` have asset, ts and frame_id; ``segments`` asset, start, end and segment columns. A segment belongs to
    the level whose bins, twice as wide at each level, are about its length, so it meets two or three of them; a
    frame's window meets one or two bins at each level that there is. A pair is kept in the first bin that both have.
    So one long asset is spread over its bins, and no long segment over many.
    """
    width = before + after
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(width)) / width))).cast("int")
    sound = segments.filter("start <= end").withColumn("level", level)
    top = sound.agg(F.max("level")).first()[0] or 0

    def bin_of(x: Column) -> Column:
        return F.floor(x / (width * F.pow(F.lit(2.0), F.col("level")))).cast("bigint")

    lo, hi = F.col("ts") - before, F.col("ts") + after
    f = frames.filter("ts is not null").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("bin", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    s = sound.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))))
    first = F.greatest(bin_of(lo), bin_of(F.col("start")))
    return f.join(s, ["asset", "level", "bin"]).filter((F.col("end") >= lo) & (F.col("start") <= hi) & (F.col("bin") == first)).drop("level", "bin")


def theta_pairs(frames: DataFrame, segments: DataFrame, before: float = BEFORE, after: float = AFTER) -> DataFrame:
    """The same without bins: an equi-join on asset with the overlap as a condition."""
    return frames.join(segments, "asset").filter((F.col("end") >= F.col("ts") - before) & (F.col("start") <= F.col("ts") + after))


def aligned(frames: DataFrame, segments: DataFrame, before: float = BEFORE, after: float = AFTER) -> DataFrame:
    """Every frame with ``content``, its segments' texts in order of start joined by spaces, and ``need_vision``.

    Frames without a segment stay, with empty content. The number of segments for a frame is bounded by the window.
    """
    pairs = overlap_pairs(frames.select("asset", "ts", "frame_id"), segments.select("asset", "start", "end", "segment_id", "text"), before, after)
    texts = pairs.groupBy("asset", "frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "segment_id", "text"))), lambda s: stripped(s["text"])), " ").alias("content"))
    joined = frames.join(texts, ["asset", "frame_id"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    return joined.withColumn("need_vision", F.length("content") < SHORT)
