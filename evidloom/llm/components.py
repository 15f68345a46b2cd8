"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """Each vertex's smallest neighbour, itself included."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each vertex go to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each vertex, and the vertex, go to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), "u")
    return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for every vertex of ``edges`` (u, v); loops are ignored.

    Each round is written to shared storage and the one before deleted; the number of rounds grows with the logarithm of
    the longest path. Vertices without an edge to another are left out.
    """
    now, seen = written(edges.select("u", "v").filter("u <> v").distinct()), None
    while True:  # ends when a round changes nothing
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            found = written(now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct())
            discard(now)
            return found
        seen, last = state, now
        now = written(_small(_large(last)))
        discard(last)
