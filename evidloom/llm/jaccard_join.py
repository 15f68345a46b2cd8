"""N-gram Jaccard join by grouped prefixes.

Texts are sets of hashed word shingles; equal sets are one class. All shingles are ordered by the number of classes
that have them (counted exactly, in buckets that each block sends four bytes for each shingle to), rare ones first.
Two sets of similarity t share a shingle among the first ``n - ceil(t n) + 1`` of each, so only classes with a
shared shingle there are looked at; shingles of one class are never sent on.

Classes with identical prefixes and size are one group. A list of groups stands under each prefix shingle; pairs of
groups are filtered by size, place in the prefix and component, then expanded to members and verified. Links come in
rounds: in each, a group meets few others of its lists (those with the fewest shingles of their own, some by hash),
never all; after each, components are taken, and a list whose members are in one component is done. What lists are left
with members in several components are compared in full, long lists chunk by chunk. So every link between different
components is found, and a group of copies costs a few pairs for each copy. ``similar`` gives all links instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import discard, give_back, giving_back, pieces_of, written
from evidloom.llm.components import components
from evidloom.llm.shingles import shingle_sets, signature
from evidloom.llm.token_counts import slices

PERCENT = 80
#: Groups of a list that one task compares with as many others.
CHUNK = 512
#: Texts and bytes that are hashed at a time; one text at least.
TEXTS, SLICE_BYTES = 512, 4 << 20
#: How many blocks' bytes a bucket of shingles stands for; a block sends rows only to buckets that it has a shingle for.
COUNTED = 2
#: Partners for each group in each round before what is left is compared in full.
ROUNDS = (6,)
ROUTED = "block int, bucket int, keys binary, counts binary"
SETS = "vid bigint, n int, unique int, k1 bigint, k2 bigint, k int, tokens array<bigint>"


def _texts(column: pa.ChunkedArray) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.combine_chunks().cast(pa.large_binary())]


def place_of(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def signatures(docs: DataFrame, size: int, text_col: str, name: str) -> DataFrame:
    """``docs`` with the size of its set in ``name``_n and the set's signature (null if empty) in ``name``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, TEXTS, SLICE_BYTES):
                sets = shingle_sets(_texts(pa.chunked_array([part.column(at)])), size)
                more = [pa.array([signature(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, name, f"{name}_n"])

    return docs.mapInArrow(giving_back(run), docs.select("*", F.lit(None).cast("binary").alias(name), F.lit(None).cast("bigint").alias(f"{name}_n")).schema)


def _block(docs: pa.Table, chosen: dict[bytes, int], size: int) -> tuple[list[int], list[np.ndarray]]:
    """Numbers and sets of the classes that this block stands for."""
    vids, sets = [], []
    for part in slices(docs.select(["text"]), TEXTS, SLICE_BYTES):
        for s in shingle_sets(_texts(part.column("text")), size):
            vid = chosen.pop(signature(s), None)
            if vid is not None:
                vids.append(vid)
                sets.append(s)
    return vids, sets


def _buckets(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that have one of the shingles (in order), and where each begins and the last one ends."""
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    full, at = np.unique(bucket.astype(np.int64), return_index=True)
    return full, np.append(at, len(distinct))


def candidate_sets(docs: DataFrame, classes: DataFrame, n: int, size: int, percent: int) -> DataFrame:
    """Classes that may have a partner: size, shingles that others have too in order, and how many are in the prefix.

    ``docs`` (block, text) and ``classes`` (block, sig, vid) come together by block; blocks and buckets of shingles
    exchange counts. ``k1`` and ``k2`` stand for the size and prefix.
    """

    def named(classes: pa.Table) -> dict[bytes, int]:
        return dict(zip(classes.column("sig").to_pylist(), classes.column("vid").to_pylist(), strict=True))

    def send(key, docs, classes):
        give_back()  # what the group before left
        sets = _block(docs, named(classes), size)[1]
        distinct, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
        # A block's share of a count is cut at 255; only the order of shingles depends on it, never which are shared.
        low, few = distinct.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        full, at = _buckets(distinct, n)
        cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        return pa.table([pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([low[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([few[i:j].tobytes() for i, j in cut], pa.binary())], ["block", "bucket", "keys", "counts"])

    def count(key, rows):
        """Steps of an eighth of a power of two of how many classes have each shingle; 0 for one."""
        give_back()
        keys = [np.frombuffer(x, np.uint32) for x in rows.column("keys").to_pylist()]
        few = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8)
        _, own = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(own, few)
        step = np.minimum(255, np.floor(8 * np.log2(total))).astype(np.uint8)[own]
        cut = np.append(0, np.cumsum([len(x) for x in keys]))
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array([None] * len(keys), pa.binary()), pa.array([step[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["block", "bucket", "keys", "counts"])

    def order(key, docs, told):
        give_back()
        replies = told.filter(pc.is_valid(told.column("bucket")))
        vids, sets = _block(docs, named(told.filter(pc.is_null(told.column("bucket")))), size)
        out: dict[str, list] = {c: [] for c in ("vid", "n", "unique", "k1", "k2", "k", "tokens")}
        if sets:
            everything = np.concatenate(sets)
            distinct, own = np.unique(everything, return_inverse=True)
            full, at = _buckets(distinct, n)
            step = np.zeros(len(distinct), np.uint8)
            for b, x in zip(np.searchsorted(full, replies.column("bucket").to_numpy()).tolist(), replies.column("counts").to_pylist(), strict=True):
                step[at[b] : at[b + 1]] = np.frombuffer(x, np.uint8)
            step = step[own]
            end = 0
            for vid, s in zip(vids, sets, strict=True):
                begin, end = end, end + len(s)
                of = step[begin:end]
                shared = np.flatnonzero(of)
                unique = len(s) - len(shared)
                k = prefix_length(len(s), percent) - unique
                if k <= 0:
                    continue
                tokens = s[shared][np.lexsort((s[shared], of[shared]))]
                key = np.frombuffer(hashlib.blake2b(len(s).to_bytes(8, "little") + tokens[:k].tobytes(), digest_size=16).digest(), np.int64)
                for c, x in zip(out, (vid, len(s), unique, int(key[0]), int(key[1]), k, tokens.view(np.int64)), strict=True):
                    out[c].append(x)
        kinds = {"n": pa.int32(), "unique": pa.int32(), "k": pa.int32(), "tokens": pa.list_(pa.int64())}
        return pa.table({c: pa.array(x, kinds.get(c, pa.int64())) for c, x in out.items()})

    by_block = docs.groupBy("block")
    sent = by_block.cogroup(classes.groupBy("block")).applyInArrow(send, ROUTED)
    replies = sent.groupBy("bucket").applyInArrow(count, ROUTED).select("block", "bucket", "counts")
    told = replies.unionByName(classes.select("block", "sig", "vid"), allowMissingColumns=True)
    return by_block.cogroup(told.groupBy("block")).applyInArrow(order, SETS)


def _sizes_agree(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)).cast("bigint") >= percent * F.greatest(a, b)


def _places_agree(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Whether what is left behind the shared shingle's places can make the overlap that the sizes ask for."""
    most = F.least(x["n"] - x["pos"], y["n"] - y["pos"]).cast("bigint")
    return most * (100 + percent) >= percent * (x["n"] + y["n"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are as similar as asked for."""
    a, b = (sets.select(F.col("vid").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}")) for s in "uv")
    both = pairs.join(a, "u").join(b, "v").withColumn("common", F.size(F.array_intersect("t_u", "t_v")))
    return both.filter(100 * F.col("common") >= percent * (F.col("n_u") + F.col("n_v") - F.col("common"))).select("u", "v")


def links(sets: DataFrame, percent: int, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """Components (vertex, component) of all links between the classes in ``sets``; classes without one are left out."""
    spark = sets.sparkSession
    own = sets.select("vid", "n", "k1", "k2")
    first = own.groupBy("k1", "k2").agg(F.min("vid").alias("gid"), F.count(F.lit(1)).alias("members"))
    members = written(own.join(first, ["k1", "k2"]).select("vid", "gid", "n", "members"))
    leaders = members.filter("vid = gid").select("vid", "members")
    prefixes = sets.join(leaders, "vid").select(F.col("vid").alias("gid"), "n", "unique", "members", F.posexplode(F.slice("tokens", F.lit(1), F.col("k"))).alias("p", "token"))
    lists = written(prefixes.select("token", "gid", "n", "members", (F.col("unique") + F.col("p")).alias("pos")))
    tokens = lists.groupBy("token").agg(F.sum("members").alias("all"), F.min_by(F.struct("gid", "n", "pos"), _few_own("pos", "gid", 0)).alias("y")).filter("all > 1")
    tokens = tokens.select("token", F.col("y.gid").alias("v"), F.col("y.n").alias("n_v"), F.col("y.pos").alias("pos_v"))
    # Round one: each group against that of its lists with the fewest shingles of its own, each member against its group's first.
    met = lists.join(tokens, "token").filter(F.col("gid") != F.col("v"))
    here, there = ({"n": F.col("n"), "pos": F.col("pos")}, {"n": F.col("n_v"), "pos": F.col("pos_v")})
    leads = met.filter(_sizes_agree(F.col("n"), F.col("n_v"), percent) & _places_agree(here, there, percent)).groupBy(F.col("gid").alias("u")).agg(F.min_by("v", _few_own("pos_v", "v", 0)).alias("v"))
    within = members.filter("vid <> gid").select(F.col("vid").alias("u"), F.col("gid").alias("v"))
    edges = written(verified(leads.unionByName(within), sets, percent))
    component = components(edges)
    alive = written(lists.join(tokens.select("token"), "token").select("token", "gid", "n", "pos"))
    for many in (*rounds, None):
        of = written(members.join(component.withColumnRenamed("vertex", "vid"), "vid", "left").select("vid", "gid", F.coalesce("component", "vid").alias("c")))
        groups = written(of.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")))
        placed = alive.select("token", "gid", "n", "pos").join(groups, "gid")
        open_ = placed.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("token")
        entries = written(placed.join(open_, "token"))
        if entries.isEmpty():
            discard(of, groups, entries)
            break
        pairs = written(_some(entries, of, many, percent) if many else _expanded(written(_all(entries, percent)), of))
        more = written(verified(pairs, sets, percent))
        discard(of, groups, pairs, alive)
        alive = entries
        if not more.isEmpty():
            known, before = component.select(F.col("vertex").alias("u"), F.col("component").alias("v")), component
            component = components(known.unionByName(more))
            discard(before)
        discard(more)
    discard(members, lists, edges, alive)
    return component


def _few_own(pos: str, vid: str, seed: int) -> Column:
    """Orders by place, so by how many shingles a set has before the shared one; ties by hash."""
    return F.shiftleft(F.col(pos).cast("bigint"), 32) + F.pmod(F.xxhash64(F.lit(seed), F.col(vid)), F.lit(1 << 32))


def _apart(x: str, y: str) -> Column:
    """Whether two groups, given by the least and greatest component of their members, aren't all in one component."""
    return ~((F.col(f"{x}lo") == F.col(f"{x}hi")) & (F.col(f"{y}lo") == F.col(f"{y}hi")) & (F.col(f"{x}lo") == F.col(f"{y}lo")))


def _fits(x: str, y: str, percent: int) -> Column:
    """Whether sizes and places of two entries of a list let their sets be similar, and their components may still be joined."""
    a, b = ({"n": F.col(f"{p}n"), "pos": F.col(f"{p}pos")} for p in (x, y))
    return _apart(x, y) & _sizes_agree(a["n"], b["n"], percent) & _places_agree(a, b, percent)


def _some(entries: DataFrame, of: DataFrame, many: int, percent: int) -> DataFrame:
    """For each group at most ``many`` others of its lists: half with few shingles of their own, half by hash.

    Each member is paired with the other group's first one. Copies of one text with changes of their own are all
    nearest to the ones with the fewest changes.
    """
    fields = F.struct("gid", "n", "pos", "lo", "hi")
    picks = entries.groupBy("token").agg(F.array(*(F.min_by(fields, F.xxhash64(F.lit(many * 100 + i), F.col("gid")) if i % 2 else _few_own("pos", "gid", many * 100 + i)) for i in range(many))).alias("picks"))
    met = entries.join(picks, "token").select("gid", "n", "pos", "lo", "hi", F.posexplode("picks").alias("i", "y"))
    fit = met.filter((F.col("gid") != F.col("y.gid")) & _fits("", "y.", percent))
    chosen = fit.groupBy("gid", "i").agg(F.min_by("y.gid", F.xxhash64("i", "y.gid")).alias("v")).select("gid", "v")
    both = chosen.unionByName(chosen.select(F.col("v").alias("gid"), F.col("gid").alias("v"))).distinct()
    pairs = both.join(of.select("gid", F.col("vid").alias("u"), "c"), "gid").join(of.select(F.col("vid").alias("v"), F.col("c").alias("d")), "v").filter("c <> d")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _all(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of groups (g, h) that share a list and fit, a group with itself too if its members are apart.

    A list of many groups is cut into chunks by hash, and each pair of chunks meets under a key of its own. Groups in
    a list's largest component are only met by others, never by themselves.
    """
    whole = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    sizes = entries.groupBy("token", whole.alias("c")).agg(F.count(F.lit(1)).alias("many"))
    lists = sizes.groupBy("token").agg(F.max_by("c", F.when(F.col("c").isNotNull(), F.col("many"))).alias("largest"), F.ceil(F.sum("many") / CHUNK).cast("int").alias("chunks"))
    cut = entries.join(lists, "token").withColumn("chunk", F.pmod(F.xxhash64("gid"), F.col("chunks")).cast("int")).withColumn("inside", F.coalesce(whole == F.col("largest"), F.lit(False)))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = cut.filter(~F.col("inside")).withColumn("j", every).select("token", F.col("chunk").alias("i"), "j", "gid", "n", "pos", "lo", "hi")
    right = cut.withColumn("i", every).select("token", "i", F.col("chunk").alias("j"), F.struct("gid", "n", "pos", "lo", "hi", "inside").alias("y"))
    once = F.col("y.inside") | (F.col("gid") <= F.col("y.gid"))
    met = left.join(right, ["token", "i", "j"]).filter(once & _fits("", "y.", percent))
    return met.select(F.greatest("gid", "y.gid").alias("g"), F.least("gid", "y.gid").alias("h")).distinct()


def _expanded(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The members (u, v) of pairs of groups that are in different components."""
    a, b = of.select(F.col("gid").alias("g"), F.col("vid").alias("x"), "c"), of.select(F.col("gid").alias("h"), F.col("vid").alias("y"), F.col("c").alias("d"))
    met = pairs.join(a, "g").join(b, "h").filter((F.col("c") != F.col("d")) & ((F.col("g") != F.col("h")) | (F.col("x") < F.col("y"))))
    return met.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))


def all_links(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (u, v) of classes in ``sets`` that are linked, u above v: every pair of groups, expanded and verified."""
    own = sets.select("vid", "k1", "k2")
    of = written(own.join(own.groupBy("k1", "k2").agg(F.min("vid").alias("gid")), ["k1", "k2"]).select("vid", "gid", F.col("vid").alias("c")))
    groups = of.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    prefixes = sets.join(groups, sets["vid"] == groups["gid"]).select("gid", "n", "unique", "lo", "hi", F.posexplode(F.slice("tokens", F.lit(1), F.col("k"))).alias("p", "token"))
    entries = written(prefixes.select("token", "gid", "n", (F.col("unique") + F.col("p")).alias("pos"), "lo", "hi"))
    return verified(written(_expanded(written(_all(entries, percent)), of)), sets, percent)


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, block_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, sig), classes (sig, id, rows, vid), and the sets of classes that may have a partner."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), place_of(id_col, text_col).alias("place"))
    rows = written(signatures(own, size, "text", "sig").select("doc_id", F.col("sig_n").alias("n"), "sig", "place"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = pieces_of(total, block_bytes)
    block = F.pmod(F.col("place"), F.lit(blocks)).cast("int").alias("block")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place"))
    classes = rows.filter("sig is not null").groupBy("sig").agg(first.alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes.select("sig", F.col("first.doc_id").alias("id"), "first.place", "rows").withColumn("vid", F.monotonically_increasing_id()))
    sets = candidate_sets(own.select(block, "text"), classes.select(block, "sig", "vid"), pieces_of(total, COUNTED * block_bytes), size, percent)
    return rows, classes, written(sets)


def _classified(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, sig), and classes (sig, id, rows, component_id, first)."""
    rows, classes, sets = _sets(docs, id_col, text_col, size, percent, block_bytes)
    found = links(sets, percent)
    discard(sets)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.hex("sig").alias("sig")))
    joined = classes.join(found.select(F.col("vertex").alias("vid"), "component"), "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    heads = joined.groupBy("component").agg(least.alias("head"))
    return rows, joined.join(heads, "component").select("sig", "id", "rows", F.col("head.id").alias("component_id"), (F.col("head.sig") == F.hex("sig")).alias("first"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT, block_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links (class_u, class_v) between different texts, and the rows (doc_id, class) of the classes.

    A class is a set of shingles; its rows are all linked with each other and with the rows of linked classes. Rows
    without a word have no class.
    """
    rows, classes, sets = _sets(docs, id_col, text_col, size, percent, block_bytes)
    found = all_links(sets, percent).select(F.col("u").alias("class_u"), F.col("v").alias("class_v"))
    return found, rows.join(classes.select("sig", F.col("vid").alias("class")), "sig", "left").select("doc_id", "class")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT, block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_shingles`` and ``component_id``.

    Texts whose shingle sets have ``100 * intersection >= percent * union`` are linked; a component's id is the
    smallest id reachable by links. A null or blank text has no shingles and is alone; a null id is the id of a
    component only where all ids in it are null; repeated rows have a row each. Other columns are left out.
    """
    rows, classes = _classified(docs, id_col, text_col, size, percent, block_bytes)
    joined = rows.join(classes.select("sig", "component_id"), "sig", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with one row of each component, one with the smallest id; rows without a word all stay.

    All columns stay, whatever their names. Where several rows share that id and text, one of them stays.
    """
    rows, classes = _classified(docs, id_col, text_col, size, percent, block_bytes)
    heads = classes.filter("first").select(F.col("sig").alias("head_sig"), F.col("id").alias("head_id"))
    at = rows.groupBy("sig", "doc_id", "place").agg(F.count(F.lit(1)).alias("copies"))
    of_head = at.join(heads, (F.col("sig") == F.col("head_sig")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    one = of_head.groupBy("sig", "doc_id").agg(F.min(F.struct("place", "copies")).alias("first")).select("doc_id", "first.*")
    keys = one.unionByName(at.filter("sig is null").select("doc_id", "place", F.lit(1).alias("copies")))
    # Rows are known again by id and hash, so no text goes through Python a second time.
    inner = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("own_id"), place_of(id_col, text_col).alias("own_place"))
    kept = inner.join(keys, (F.col("own_place") == F.col("place")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    once = kept.filter("copies = 1")
    return once.unionByName(kept.filter("copies > 1").dropDuplicates(["own_id", "own_place"])).select("row.*")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
five AS (SELECT r, {', '.join(f"unnest(w[{i + 1}:len(w) - {4 - i}]) AS w{i}" for i in range(5))} FROM d WHERE len(w) >= 5),
sh AS MATERIALIZED (SELECT DISTINCT r, concat_ws(' ', w0, w1, w2, w3, w4) AS s FROM five UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y),
least_ AS (SELECT x, min(doc_id) AS m FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, m) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN least_ ON x = r
"""
