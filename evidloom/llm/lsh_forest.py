"""MinHash near-duplicates by an LSH forest: signatures sorted in several orders, neighbours by longest common prefix.

Texts are sets of hashed word shingles; equal sets are one class. A class has a signature of ``HASHES`` minimum hashes.
Order t sorts the signatures from position ``STEP * t`` on, wrapping round; a region is a run of an order with a common
prefix. Two classes of similarity 0.85 miss every common prefix of four with a chance of 2e-8, and a share of equal
hashes under ``AGREED`` with one of 1e-9: that is what a link may be lost by. Links are confirmed on the full sets.

Candidates come first from neighbours in each order, which have the longest prefixes in common, and from each
region's member with the fewest shingles of its own, in regions as deep as makes them small: where many classes lie,
regions are cut by longer prefixes. Each class checks the best few of these. After that components are taken, and only
regions that still have several components are compared on: first by a few picks of each region, then in full at the
least depth, in chunks; there a pair is passed over only when sizes, shingles of their own or parities of shingles say
that it can't be similar enough. So a group of thousands of near copies costs a few pairs for each of them, and nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm import jaccard_join
from evidloom.llm.common import discard, written
from evidloom.llm.components import components
from evidloom.llm.shingles import mixed, shingle_sets, signature
from evidloom.llm.token_counts import slices

PERCENT = 85
#: Hashes of a signature, how far each order is moved on, and so the orders; hashes are kept as two bytes.
HASHES, STEP = 96, 4
ORDERS = HASHES // STEP
#: Prefix lengths from which a region's is taken: the next one where it has more than ``DENSE`` classes.
DEPTHS, DENSE = (4, 8, 16, 32), 64
#: Equal hashes that a pair needs to be looked at, neighbours on either side, and picks of a region.
AGREED, NEIGHBOURS, PICKS = 60, 2, 4
#: Bits of the parities of a set: pairs of sets that differ in d shingles differ in d bits at most.
PARITIES = 512
#: Texts and bytes that are taken up at a time.
TEXTS, SLICE_BYTES = 512, 4 << 20
_U = np.uint64
_draw = np.random.Generator(np.random.PCG64(23))
_XOR, _TIMES = _draw.integers(0, 1 << 63, HASHES, np.uint64), _draw.integers(0, 1 << 63, HASHES, np.uint64) * _U(2) + _U(1)


def minima(sets: list[np.ndarray]) -> list[bytes | None]:
    """The signature of each set, ``HASHES`` big-endian numbers of two bytes; none for the empty set."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[bytes | None] = [None] * len(sets)
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        found = np.empty((len(full), HASHES), ">u2")
        for h in range(HASHES):
            found[:, h] = mixed(np.minimum.reduceat((flat ^ _XOR[h]) * _TIMES[h], at)) & _U(0xFFFF)
        for i, row in zip(full, found, strict=True):
            out[i] = row.tobytes()
    return out


def _sets_of(part: pa.RecordBatch, at: int, size: int) -> list[np.ndarray]:
    return shingle_sets(jaccard_join._texts(pa.chunked_array([part.column(at)])), size)


def signed(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (doc_id, place, text) without the text, with size, signature and minimum hashes of each set; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXTS, SLICE_BYTES):
                sets = _sets_of(part, 2, size)
                more = [pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.array(minima(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *more], ["doc_id", "place", "n", "sig", "mins"])

    return written(docs.mapInArrow(run, "doc_id bigint, place bigint, n bigint, sig binary, mins binary"))


def region(order: Column, mins: Column, depth: int) -> Column:
    """Names the region of ``depth`` hashes that a signature is in under an order."""
    return F.xxhash64(order, F.lit(depth), F.substr(F.concat(mins, mins), 1 + 2 * STEP * order, F.lit(2 * depth)))


def in_regions(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` without ``mins``, for each order once, with the ``token`` of the region."""
    each = rows.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    return each.withColumn("token", region(F.col("order"), F.col("mins"), depth)).drop("mins", "order")


def full_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(vid, n, tokens, bits) of ``classes`` (place, sig, vid), from the text that stands for each; written."""
    texts = docs.groupBy("place").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXTS, SLICE_BYTES):
                own = [(v, s) for v, sig, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _sets_of(part, 2, size), strict=True) if signature(s) == sig]
                lists = pa.array([s.view(np.int64) for _, s in own], pa.list_(pa.int64()))
                bits = pa.array([parities(s) for _, s in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()), lists, bits], ["vid", "n", "tokens", "bits"])

    return written(classes.join(texts, "place").select("vid", "sig", "text").mapInArrow(run, "vid bigint, n bigint, tokens array<bigint>, bits array<bigint>"))


def parities(found: np.ndarray) -> np.ndarray:
    """For each of ``PARITIES`` buckets of shingles whether an odd number of the set's is in it, as words of 64 bits."""
    odd = np.bincount((found & _U(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def with_own(sets: DataFrame) -> DataFrame:
    """(vid, n, bits, pos): how many of a set's shingles no other one of ``sets`` has."""
    each = sets.select("vid", F.explode("tokens").alias("token"))
    alone = each.groupBy("token").agg(F.min("vid").alias("vid"), F.max("vid").alias("other")).filter("vid = other")
    return sets.select("vid", "n", "bits").join(alone.groupBy("vid").agg(F.count(F.lit(1)).alias("pos")), "vid", "left").fillna(0, ["pos"])


def compared(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs (u, v) of classes that share a region, are in different components and may be similar.

    A region of many classes is cut into chunks by hash, and each pair of chunks meets under a key of its own. Classes
    in a region's largest component are only met by others, never by themselves.
    """
    sizes = entries.groupBy("token", "c").agg(F.count(F.lit(1)).alias("many"))
    regions = sizes.groupBy("token").agg(F.max_by("c", F.struct("many", "c")).alias("largest"), F.ceil(F.sum("many") / jaccard_join.CHUNK).cast("int").alias("chunks"))
    cut = entries.join(regions, "token").withColumn("chunk", F.pmod(F.xxhash64("gid"), F.col("chunks")).cast("int")).withColumn("inside", F.col("c") == F.col("largest"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = cut.filter(~F.col("inside")).withColumn("j", every).select("token", F.col("chunk").alias("i"), "j", "gid", "n", "pos", "c", "bits")
    right = cut.withColumn("i", every).select("token", "i", F.col("chunk").alias("j"), F.struct("gid", "n", "pos", "c", "bits", "inside").alias("y"))
    once = F.col("y.inside") | (F.col("gid") < F.col("y.gid"))
    here, there = {"n": F.col("n"), "pos": F.col("pos")}, {"n": F.col("y.n"), "pos": F.col("y.pos")}
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(PARITIES // 64)), F.lit(0))
    # Sets of similarity s differ in (1 - s) / (1 + s) of the sum of their sizes at most.
    near = apart * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("y.n"))
    fit = once & (F.col("c") != F.col("y.c")) & jaccard_join._places_agree(here, there, percent) & near
    return left.join(right, ["token", "i", "j"]).filter(fit).select(F.greatest("gid", "y.gid").alias("u"), F.least("gid", "y.gid").alias("v")).distinct()


def _equal_hashes(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), ">u2").reshape(-1, HASHES) for c in (a, b))
    return (x == y).sum(axis=1)


def agreeing(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (u, v) that enough hashes of their signatures agree for, with their number in ``agreed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _equal_hashes(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["u", "v", "agreed"]).filter(pa.array(n >= AGREED))

    a, b = info.select(F.col("vid").alias("u"), F.col("mins").alias("x")), info.select(F.col("vid").alias("v"), F.col("mins").alias("y"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(run, "u bigint, v bigint, agreed bigint")


def neighbours(info: DataFrame, percent: int) -> DataFrame:
    """(u, v, agreed) both ways for classes that stand next to each other in an order and may be similar.

    The order is dealt out by ranges and read as a stream, so a dense region is many tasks' work; the few pairs that
    a border parts are met in other orders or left to the comparison of regions.
    """
    mins = F.col("mins")
    turned = F.substr(F.concat(mins, mins), 1 + 2 * STEP * F.col("order"), F.lit(2 * HASHES))
    each = info.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))).select("order", turned.alias("turned"), "vid", "n", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            rows = table.to_batches()[0]
            begun = 0 if rest is None else rest.num_rows
            order, vid, n, pos = (rows.column(i).to_numpy() for i in (0, 2, 3, 4))
            hashes = np.frombuffer(b"".join(rows.column(1).to_pylist()), ">u2").reshape(-1, HASHES)
            out: list[list[np.ndarray]] = [[], [], []]
            for lag in range(1, NEIGHBOURS + 1):
                j = np.arange(max(lag, begun), rows.num_rows)
                i = j - lag
                share = np.minimum(n[i] - pos[i], n[j] - pos[j])
                fit = (order[i] == order[j]) & (share * (100 + percent) >= percent * (n[i] + n[j]))
                i, j = i[fit], j[fit]
                same = hashes[i] == hashes[j]
                agreed = same.sum(axis=1)
                near = same[:, : DEPTHS[0]].all(axis=1) & (agreed >= AGREED)
                for column, x, y in zip(out, (vid[i], vid[j], agreed), (vid[j], vid[i], agreed), strict=True):
                    column += [x[near], y[near]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["u", "v", "agreed"])
            rest = rows.slice(max(0, rows.num_rows - NEIGHBOURS))

    return each.repartitionByRange("order", "turned").sortWithinPartitions("order", "turned").mapInArrow(run, "u bigint, v bigint, agreed bigint")


def leaders(info: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v): v has the fewest shingles of its own in a region with u, at each depth until regions are small."""
    found, rows = None, info.select("vid", "n", "pos", "mins")
    here, there = {"n": F.col("n"), "pos": F.col("pos")}, {"n": F.col("y.n"), "pos": F.col("y.pos")}
    for depth in DEPTHS:
        each = in_regions(rows, depth)
        heads = each.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min_by(F.struct("vid", "n", "pos"), jaccard_join._few_own("pos", "vid", depth)).alias("y")).filter("many > 1")
        fit = (F.col("vid") != F.col("y.vid")) & jaccard_join._sizes_agree(F.col("n"), F.col("y.n"), percent) & jaccard_join._places_agree(here, there, percent)
        met = each.join(heads, "token")
        pairs = met.filter(fit).select(F.col("vid").alias("u"), F.col("y.vid").alias("v"), F.col("y.pos").alias("own"))
        found = pairs if found is None else found.unionByName(pairs)
        rows = info.select("vid", "n", "pos", "mins").join(met.filter(F.col("many") > DENSE).select("vid").distinct(), "vid", "left_semi")
    return found.distinct()


def links(info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (vertex, component) of all links between classes; ``info`` has vid, n, pos, bits and mins, ``sets`` the tokens."""
    near, led = neighbours(info, percent), written(leaders(info, percent))
    told = agreeing(led.select("u", "v"), info)
    best = near.unionByName(told).groupBy("u").agg(F.max_by("v", F.struct("agreed", -F.col("v"))).alias("v"))
    central = led.join(told, ["u", "v"]).groupBy("u").agg(F.min_by("v", F.struct("own", "v")).alias("v"))
    both = best.unionByName(central).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(jaccard_join.verified(both, sets, percent))
    component = components(edges)
    discard(led)
    entries = in_regions(info, DEPTHS[0]).withColumnRenamed("vid", "gid")
    for many in (PICKS, None):
        of = info.select("vid").join(component.withColumnRenamed("vertex", "vid"), "vid", "left").select(F.col("vid").alias("gid"), "vid", F.coalesce("component", "vid").alias("c"))
        of = written(of)
        placed = entries.join(of.select("gid", F.col("c").alias("lo"), F.col("c").alias("hi")), "gid")
        open_ = placed.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("token")
        left = written(placed.join(open_, "token"))
        pairs = jaccard_join._some(left, of, many, percent) if many else compared(left.withColumnRenamed("lo", "c"), percent)
        more = written(jaccard_join.verified(agreeing(pairs, info).select("u", "v"), sets, percent))
        discard(of, left)
        if not more.isEmpty():
            known, before = component.select(F.col("vertex").alias("u"), F.col("component").alias("v")), component
            component = components(known.unionByName(more))
            discard(before)
        discard(more)
    discard(edges)
    return component


def _classified(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, place, n, sig), and classes (sig, component_id, first id and place of a component's head)."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("doc_id", "text").alias("place"), "text")
    rows = signed(own, size)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    classes = rows.filter("sig is not null").groupBy("sig").agg(first.alias("first"), F.first("mins").alias("mins"))
    classes = written(classes.select("sig", F.col("first.doc_id").alias("id"), "first.place", "mins").withColumn("vid", F.monotonically_increasing_id()))
    entries = in_regions(classes.select("vid", "mins"), DEPTHS[0])
    shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    alive = written(classes.join(entries.join(shared, "token", "left_semi").select("vid").distinct(), "vid", "left_semi"))
    sets = full_sets(own, alive.select("place", "sig", "vid"), size)
    # A set that has too few shingles in common with all others together has no link.
    info = written(with_own(sets).filter(100 * (F.col("n") - F.col("pos")) >= percent * F.col("n")).join(alive.select("vid", "mins"), "vid"))
    found = links(info, sets, percent)
    discard(alive, sets, info)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.hex("sig").alias("sig")))
    joined = classes.drop("mins").join(found.select(F.col("vertex").alias("vid"), "component"), "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    heads = joined.groupBy("component").agg(least.alias("head"))
    return rows.drop("mins"), joined.join(heads, "component").select("sig", F.col("head.id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts whose shingle sets have ``100 * intersection >= percent * union`` are linked (a percent of 85 or more, which
    the orders are made for); a component's id is the smallest id reachable by links, and the row with that id is kept.
    A null or blank text has no shingles, is alone and kept. A null id is the id of a component only where all ids in
    it are null, and is kept there. Repeated rows have a row each and are kept alike. Other columns are left out.
    """
    if percent < PERCENT:
        raise ValueError(f"the orders find links from {PERCENT} percent on")
    rows, classes = _classified(docs, id_col, text_col, size, percent)
    joined = rows.join(classes, "sig", "left").withColumn("component", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


ORACLE = jaccard_join.ORACLE.replace(">= 80 *", ">= 85 *").replace("least(doc_id, m) AS component_id", "least(doc_id, m) AS component_id, coalesce(doc_id = least(doc_id, m), doc_id IS NULL) AS kept")
