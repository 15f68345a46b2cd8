"""Mixing sources to target weights: exact block quotas split down a tree of output shards.

Each source's documents are dealt into blocks by a hash of id and text. A source that is to give ``target`` words
gives whole passes over its blocks, each pass in an order of its own, and a part of one more pass: blocks while they
fit, and of the next block the documents, by their hashes, that still fit. These draws are the source's quota. A
tree over the shards divides all quotas: at each node the sources' blocks for the left half are drawn from the
multivariate hypergeometric distribution, source by source, by inversion of a uniform hash. A shard draws the run of
each source's block sequence that its quota says, disjoint from all others, and orders its rows by hash.

Whatever the data, the tables that are planned with have a row for each source and block. Only DataFrame functions
are used; hashes take the place of random numbers, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidloom.llm.common import fresh, log_factorial, pieces_of, text_of, written

WEIGHTS, MOST = (5, 2, 1), 3
SEED = 7
#: Least blocks of a source and least shards, and the rows of the whole table for each beyond that.
BLOCKS, SHARDS, BLOCK_ROWS, SHARD_ROWS = 1024, 16, 1 << 20, 1 << 22
#: Planned rows that are broadcast at most; more are joined by shuffle.
SMALL_PLAN = 100_000


def keys(docs: DataFrame, id_col: str, text_col: str, blocks: int, seed: int) -> tuple[Column, Column]:
    """The hash that orders a row within its block, and its block."""
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    return key, F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col)), F.lit(blocks)).cast("int")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """Per row: id, source, size in words, key and block."""
    key, block = keys(docs, id_col, text_col, blocks, seed)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"), key.alias("key"), block.alias("block"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with a number in order of the names, null last, and ``target`` words.

    Targets share the sum of all sizes by weight and stop at ``most`` times the source's size; what is over is shared
    anew by weight. In order of size by weight, a source stops there exactly if what the ones before it leave is
    more; from the first that doesn't stop on, all share by weight. One row for each source goes through one task.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("source_no", F.row_number().over(names) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1).cast("bigint")
    cap = (most * F.col("source_size")).alias("cap")
    shares = numbered.select("*", weight.alias("weight"), cap, (F.col("source_size") * math.lcm(*weights) / weight).alias("ratio"))
    by = Window.orderBy("ratio", "source_no")
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = total - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = shares.withColumns({"left": left, "open": F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    free = F.col("cap") * F.col("open") > F.col("left") * F.col("weight")
    first = F.first(F.when(free, F.struct("left", "open")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = filled.withColumn("level", first)
    return met.select("source", "source_no", "source_size", F.coalesce((F.col("level.left") * F.col("weight")).cast("double") / F.col("level.open"), F.col("cap").cast("double")).alias("target"))


def _uniform(*of: Column) -> Column:
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from ``total``, of which ``good`` are good, are good, at quantile ``u``.

    Probabilities are summed upwards from 12 standard deviations below the mean, where what lies below is under
    the last place of a double.
    """

    def log_choose(n: Column, k: Column) -> Column:
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    def invert(v: Column) -> Column:
        t, g, d = v["t"], v["g"], v["d"]
        mean = g * d / F.greatest(t, F.lit(1))
        wide = F.ceil(12 * F.sqrt(mean * (t - g) / F.greatest(t, F.lit(1)) + 1)).cast("bigint")
        mean = F.floor(mean).cast("bigint")
        lo = F.greatest(F.lit(0), d - (t - g), F.least(mean, g, d) - wide)
        hi = F.least(g, d, mean + wide)

        def walk(b: Column) -> Column:
            p = F.exp(log_choose(g, b["lo"]) + log_choose(t - g, d - b["lo"]) - log_choose(t, d))

            def step(a: Column, x: Column) -> Column:
                more = a["cum"] < v["u"]
                p = a["p"] * ((g - x) * (d - x)).cast("double") / ((x + 1) * (t - g - d + x + 1)).cast("double")
                return F.struct(p.alias("p"), F.when(more, a["cum"] + p).otherwise(a["cum"]).alias("cum"), F.when(more, x + 1).otherwise(a["x"]).alias("x"))

            steps = F.when(b["hi"] > b["lo"], F.sequence(b["lo"], b["hi"] - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.aggregate(steps, F.struct(p.alias("p"), p.alias("cum"), b["lo"].alias("x")), step, lambda a: a["x"])

        return F.transform(F.array(F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))), walk)[0]

    return F.transform(F.array(F.struct(total.cast("bigint").alias("t"), good.cast("bigint").alias("g"), draws.cast("bigint").alias("d"), u.alias("u"))), invert)[0]


def split_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source_no, n) divided among the shards: (shard, source_no, n), every source's n summing to its quota."""
    item = "array<struct<source_no:int,n:bigint>>"
    node = quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source_no").cast("int").alias("source_no"), F.col("n").cast("bigint").alias("n")))).cast(item).alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")

    def left_half(lo: Column, hi: Column, q: Column) -> Column:
        total = F.aggregate(q, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
        take = F.floor(total * F.floor((hi - lo) / 2) / F.greatest(hi - lo, F.lit(1)) + 0.5).cast("bigint")
        zero = F.struct(total.alias("t"), take.alias("d"), F.array().cast(item).alias("out"))

        def draw(a: Column, x: Column) -> Column:
            n = hypergeometric(a["t"], x["n"], a["d"], _uniform(F.lit(seed), lo, hi, x["source_no"]))

            def put(n: Column) -> Column:
                return F.struct((a["t"] - x["n"]).alias("t"), (a["d"] - n).alias("d"), F.concat(a["out"], F.array(F.struct(x["source_no"].alias("source_no"), n.alias("n")))).alias("out"))

            return F.transform(F.array(n), put)[0]

        return F.aggregate(q, zero, draw, lambda a: a["out"])

    for _ in range(math.ceil(math.log2(max(shards, 1)))):
        split = node.withColumn("l", F.when(F.col("hi") - F.col("lo") > 1, left_half(F.col("lo"), F.col("hi"), F.col("q")))).withColumn("mid", (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("int"))
        rest = F.zip_with("q", "l", lambda x, y: F.struct(x["source_no"].alias("source_no"), (x["n"] - y["n"]).alias("n")))
        left, right = F.struct("lo", F.col("mid").alias("hi"), F.col("l").alias("q")), F.struct(F.col("mid").alias("lo"), "hi", rest.alias("q"))
        node = split.select(F.explode(F.when(F.col("l").isNull(), F.array(F.struct("lo", "hi", "q"))).otherwise(F.array(left, right))).alias("x")).select("x.*")
    return node.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source_no", "x.n")


def _join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on equal or both null keys."""
    other = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    return left.join(other, on, how).drop(*(f"right_{k}" for k in keys))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """What each block of each source gives: (source, block, source_size, target, draws, part_key).

    ``draws`` lists (shard, pass, whole); of a draw that isn't whole, rows with a key up to ``part_key`` are taken.
    """
    blocks = sizes.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    per_source = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, most)
    both = written(_join(blocks, per_source, ("source",)).select("source", "block", "block_size", "source_no", "source_size", "target"))
    passes = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    draws = both.withColumn("passes", passes).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    order = Window.partitionBy("source_no").orderBy("pass", F.xxhash64(F.lit(seed), "pass", "source_no", "block"), "block")
    ordered = draws.withColumns({"cum": F.sum("block_size").over(order), "draw": F.row_number().over(order) - 1})
    before = F.col("cum") - F.col("block_size")
    taken = ordered.withColumn("whole", F.col("cum") <= F.col("target")).filter(F.col("whole") | (before < F.col("target"))).withColumn("room", F.col("target") - before)
    quotas = taken.groupBy("source_no").agg(F.count(F.lit(1)).alias("n"))
    runs = Window.partitionBy("source_no").orderBy("shard")
    leaf = split_tree(quotas, shards, seed).withColumn("until", F.sum("n").over(runs)).select(F.col("source_no").alias("leaf_no"), "shard", (F.col("until") - F.col("n")).alias("since"), "until")
    dealt = taken.join(leaf, (F.col("source_no") == F.col("leaf_no")) & (F.col("draw") >= F.col("since")) & (F.col("draw") < F.col("until")))
    part = taken.filter(~F.col("whole")).select("source", "block", "room")
    inside = _join(sizes, part, ("source", "block")).withColumn("cum", F.sum("size").over(Window.partitionBy("source", "block").orderBy("key")))
    last = inside.filter(F.col("cum") <= F.col("room")).groupBy("source", "block").agg(F.max("key").alias("part_key"))
    given = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("shard", "pass", "whole"))).alias("draws"))
    found = _join(_join(both, given, ("source", "block"), "left"), last, ("source", "block"), "left")
    return written(found.select("source", "block", "source_size", "target", F.coalesce("draws", F.array().cast("array<struct<shard:int,pass:int,whole:boolean>>")).alias("draws"), "part_key"))


def _drawn(key: Column) -> Column:
    """A row's draws: all whole ones of its block, and the partial one if its key is small enough."""
    return F.filter("draws", lambda x: x["whole"] | F.coalesce(key <= F.col("part_key"), F.lit(False)))


def _with_plan(rows: DataFrame, source: Column, block: Column, planned: DataFrame) -> DataFrame:
    other = planned.select(F.col("source").alias("plan_source"), F.col("block").alias("plan_block"), "source_size", "target", "draws", "part_key")
    small = planned.limit(SMALL_PLAN + 1).count() <= SMALL_PLAN
    return rows.join(F.broadcast(other) if small else other, source.eqNullSafe(F.col("plan_source")) & (block == F.col("plan_block")), "left")


def _divided(docs: DataFrame, shards: int | None, blocks: int | None) -> tuple[int, int]:
    """Numbers of shards and blocks as given, else following the number of rows."""
    n = docs.count() if shards is None or blocks is None else 0
    return shards or pieces_of(n, SHARD_ROWS, SHARDS), blocks or pieces_of(n, BLOCK_ROWS, BLOCKS)


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int | None = None, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, words ``taken`` (repeats counted) and the shards that got it.

    A null text has no words; null is a source like any other, the last one; rows with equal id and text are taken
    alike. Repeated ids have a row each, other columns are left out, and an empty table gives none. A source's taken
    words fall short of its target by less than one document, or one group of equal rows. ``shards`` and ``blocks``
    follow the number of rows where they aren't given.
    """
    shards, blocks = _divided(docs, shards, blocks)
    sizes = written(sized(docs, id_col, text_col, source_col, blocks, seed))
    joined = _with_plan(sizes, F.col("source"), F.col("block"), plan(sizes, weights, most, shards, seed)).withColumn("own", _drawn(F.col("key")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("own")).alias("taken"), F.transform("own", lambda x: x["shard"]).alias("shards"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int | None = None, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with ``shard`` and ``place``, the order in the shard.

    Both columns get a longer name where ``docs`` has theirs. ``shuffled`` lays the rows out.
    """
    shards, blocks = _divided(docs, shards, blocks)
    planned = plan(written(sized(docs, id_col, text_col, source_col, blocks, seed)), weights, most, shards, seed)
    key, block = keys(docs, id_col, text_col, blocks, seed)
    inner = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("own_source"), key.alias("own_key"), block.alias("own_block"))
    joined = _with_plan(inner, F.col("own_source"), F.col("own_block"), planned)
    each = joined.select("row", "own_key", F.explode(_drawn(F.col("own_key"))).alias("x"))
    shard, place = fresh(docs, "shard"), fresh(docs, "place")
    return each.select("row.*", F.col("x.shard").alias(shard), F.xxhash64(F.lit(seed + 2), "x.shard", "x.pass", "own_key").alias(place))


def shuffled(mix: DataFrame, shard: str = "shard", place: str = "place", partitions: int | None = None) -> DataFrame:
    """A range of places of one shard or a few in each partition, in order of place; the session sets how many there are."""
    ranged = mix.repartitionByRange(partitions, shard, place) if partitions else mix.repartitionByRange(shard, place)
    return ranged.sortWithinPartitions(shard, place)
