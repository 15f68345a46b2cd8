"""Removal of long byte strings that an earlier document has: suffix order inside routed segments.

Documents are dealt into blocks. Every ``length``-byte string of a text is owned by the smallest hash among its
16-byte grams, so equal strings, wherever they are, share that hash; neighbouring strings with one owner form a
run. Blocks exchange their owners' hashes by bucket and learn which other documents have them. Only runs with such
an owner travel: each block sends one copy of each distinct run with its smallest document id, a bucket orders all
suffixes of its runs (words of eight bytes sorted to a shallow depth, then blind tries) and answers one bit for each string, and the blocks cut the texts.

What moves is a few bytes for each hash and the text of repeated runs, whatever the number of copies: a passage
that a third of all documents hold is one run for each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import pieces_of
from evidloom.llm.suffix_order import deep_shallow_order, padded

GRAM = 16
C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes hashed at a time, so that arrays of 8 bytes for each stay small.
CHUNK = 1 << 20
#: How many blocks' bytes a bucket of hashes stands for; a block sends rows only to buckets that it has a hash for.
HASHED = 8
NO_ID = np.iinfo(np.int64).max

ROUTED = "block int, bucket int, kind int, hashes array<bigint>, lens array<int>, data binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return (((value >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


class Runs:
    """The runs of one block's texts, in order of document id; ``length`` is the size of the strings."""

    def __init__(self, docs: pa.Table, length: int):
        ids = docs.column("doc_id")
        ids = ids.fill_null(NO_ID).to_numpy().astype(np.int64)
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in docs.column("text").combine_chunks().cast(pa.large_binary())]
        by = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts, self.length = ids[by], [texts[i] for i in by], length
        self.nulls = self.ids == NO_ID
        self.buf = b"".join(self.texts)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.offsets = self.ends - np.array([len(t) for t in self.texts], np.int64)
        found = list(self._found())
        self.start, self.stop, value, self.doc = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found) if found else [[]] * 4))
        self.value = _mixed(value.astype(np.uint64))

    def _found(self):
        lo = 0
        while lo < len(self.texts):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.offsets[lo] + CHUNK, "right")))
            got = self._chunk(lo, hi)
            if got is not None:
                yield got
            lo = hi

    def _chunk(self, lo: int, hi: int):
        base, end, length = int(self.offsets[lo]), int(self.ends[hi - 1]), self.length
        n = end - base
        if n < length:
            return None
        x = np.ndarray((n - 7,), "<u8", self.buf, base, (1,))
        h = x[: n - GRAM + 1] * C1
        h ^= h >> np.uint64(29)
        h += x[8 : n - GRAM + 9] * C2
        h ^= h >> np.uint64(32)
        h *= C1
        h ^= h >> np.uint64(29)
        window, width = length - GRAM + 1, 1
        while 2 * width <= window:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if window > width:
            h = np.minimum(h[: width - window], h[window - width :])
        o, e = self.offsets[lo:hi] - base, self.ends[lo:hi] - base
        long = e - o >= length
        cut = np.zeros(len(h) + 1, bool)
        cut[1:-1] = h[1:] != h[:-1]
        cut[o[long]] = True
        cut[e[long] - length + 1] = True
        at = np.flatnonzero(cut)
        stop = np.append(at[1:], len(h))
        doc = np.searchsorted(o, at, "right") - 1
        ok = (at + length <= e[doc]) & (at < len(h))
        at, stop, doc = at[ok], stop[ok], doc[ok]
        return at + base, stop + base, h[at], doc + lo

    def owners(self, buckets: int):
        """Distinct values in order, whether two documents here have each, each run's value, and the buckets that have any, with bounds."""
        by = np.argsort(self.value, kind="stable")
        v, d = self.value[by], self.ids[self.doc[by]]
        first = np.append(True, v[1:] != v[:-1])[: len(v)]
        start = np.flatnonzero(first)
        last = np.append(start[1:], len(v)) - 1
        own = np.empty(len(v), np.int64)
        own[by] = np.cumsum(first) - 1
        distinct = v[start]
        full, at = np.unique(_bucket(distinct, buckets), return_index=True)
        return distinct, d[start] != d[last[: len(start)]], own, full, np.append(at, len(distinct))

    def shared(self, replies: list[dict], buckets: int, groups: int):
        """Of the runs whose owner another document has: group, number and first document of the distinct run, and the distinct runs by group."""
        distinct, _, own, full, bounds = self.owners(buckets)
        known = np.zeros(len(distinct), bool)
        for r in replies:
            if r["kind"] == 0:
                i = int(np.searchsorted(full, r["bucket"]))
                lo, hi = bounds[i], bounds[i + 1]
                known[lo:hi] = np.unpackbits(np.frombuffer(r["data"], np.uint8), count=hi - lo)
        runs = np.flatnonzero(known[own]) if len(own) else np.empty(0, np.int64)
        bucket = _bucket(self.value[runs], groups)
        kept: dict[int, dict[bytes, int]] = {}
        firsts: dict[int, list[int]] = {}
        number = np.empty(len(runs), np.int64)
        first = np.empty(len(runs), np.int64)
        buf, more = self.buf, self.length - 1
        for i, (b, lo, hi, doc) in enumerate(zip(bucket.tolist(), self.start[runs].tolist(), self.stop[runs].tolist(), self.ids[self.doc[runs]].tolist(), strict=True)):
            seen = kept.setdefault(b, {})
            number[i] = k = seen.setdefault(buf[lo : hi + more], len(seen))
            own_firsts = firsts.setdefault(b, [])
            if k == len(own_firsts):
                own_firsts.append(doc)
            first[i] = own_firsts[k]
        return runs, bucket, number, first, kept, firsts


def _rows(rows: list[dict]) -> pa.Table:
    kinds = {"block": pa.int32(), "bucket": pa.int32(), "kind": pa.int32(), "hashes": pa.list_(pa.int64()), "lens": pa.list_(pa.int32()), "data": pa.binary()}
    return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()})


def _numbers(x, dtype) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each row of ``docs``: sizes and the hash of what is left once repeats are cut.

    A byte goes if a ``length``-byte string over it also starts in a document with a smaller id. Null texts are
    empty; texts shorter than ``length`` lose nothing and cut nothing. A null id counts as larger than any other;
    rows that share an id don't cut each other. Other columns are left out, so their names don't matter.
    Whole texts are read; one text, however long, stays in one block.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, m = pieces_of(total, block_bytes), pieces_of(total, HASHED * block_bytes)
    blocks = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def send_owners(key, docs):
        distinct, multi, _, full, bounds = Runs(docs, length).owners(m)
        parts = zip(full.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        return _rows([{"block": key[0].as_py(), "bucket": b, "kind": 0, "hashes": distinct[lo:hi].view(np.int64), "data": np.packbits(multi[lo:hi]).tobytes()} for b, lo, hi in parts])

    def find_shared(key, rows):
        lists = rows.column("hashes").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        h = _numbers(lists, np.int64)
        multi = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=k) for d, k in zip(rows.column("data").to_pylist(), size, strict=True)]) if len(size) else np.empty(0)
        _, own, count = np.unique(h, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[own[multi > 0]] = True
        bits, at = shared[own], np.append(0, np.cumsum(size))
        return _rows([{"block": b, "bucket": key[0].as_py(), "kind": 0, "data": np.packbits(bits[at[i] : at[i + 1]]).tobytes()} for i, b in enumerate(rows.column("block").to_pylist())])

    def send_runs(key, docs, replies):
        if not docs.num_rows:
            return _rows([])
        _, _, _, _, kept, firsts = Runs(docs, length).shared(replies.to_pylist(), m, n)
        return _rows([{"block": key[0].as_py(), "bucket": b, "kind": 1, "hashes": firsts[b], "lens": [len(x) for x in seen], "data": b"".join(seen)} for b, seen in kept.items()])

    def order_runs(key, rows):
        firsts = _numbers(rows.column("hashes").combine_chunks(), np.int64)
        lens = rows.column("lens").combine_chunks()
        in_row = np.diff(lens.offsets.to_numpy())
        size = _numbers(lens, np.int64)
        buf = padded(b"".join(rows.column("data").to_pylist()), length)
        offset = np.cumsum(size) - size
        strings = size - length + 1
        begin = np.cumsum(strings) - strings
        pos = np.repeat(offset - begin, strings) + np.arange(int(strings.sum()))
        doc = np.repeat(firsts, strings)
        order, head = deep_shallow_order(buf, pos, length)
        start = np.flatnonzero(head)
        least = np.minimum.reduceat(doc[order], start) if len(start) else doc
        earlier = np.empty(len(pos), bool)
        earlier[order] = least[np.cumsum(head) - 1] < doc[order]
        run = np.append(0, np.cumsum(in_row))
        cut = np.append(begin, len(pos))[run]
        return _rows([{"block": b, "bucket": key[0].as_py(), "kind": 1, "data": np.packbits(earlier[cut[i] : cut[i + 1]]).tobytes()} for i, b in enumerate(rows.column("block").to_pylist())])

    def cut_texts(key, docs, replies):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        if docs.num_rows:
            found, replies = Runs(docs, length), replies.to_pylist()
            runs, bucket, number, first, kept, _ = found.shared(replies, m, n)
            gone = np.zeros(len(found.buf) + 1, np.int32)
            answers = {r["bucket"]: r["data"] for r in replies if r["kind"] == 1}
            by = np.argsort(bucket, kind="stable")
            sorted_bucket = bucket[by]
            for b, seen in kept.items():
                strings = np.array([len(x) for x in seen], np.int64) - length + 1
                begin = np.cumsum(strings) - strings
                bits = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=int(strings.sum()))
                own = by[np.searchsorted(sorted_bucket, b) : np.searchsorted(sorted_bucket, b, "right")]
                k, lo = number[own], found.start[runs[own]]
                many = strings[k]
                ends = np.cumsum(many)
                step = np.arange(int(ends[-1])) - np.repeat(ends - many, many)
                removed = (bits[np.repeat(begin[k], many) + step] > 0) | np.repeat(first[own] < found.ids[found.doc[runs[own]]], many)
                at = (np.repeat(lo, many) + step)[removed]
                gone[at] += 1  # each string of a text is in one run, so no place comes twice
                gone[at + length] -= 1
            covered = np.cumsum(gone[:-1]) > 0
            data = np.frombuffer(found.buf, np.uint8)
            for i, (lo, hi) in enumerate(zip(found.offsets.tolist(), found.ends.tolist(), strict=True)):
                c = covered[lo:hi]
                k = int(c.sum())
                out["doc_id"].append(None if found.nulls[i] else int(found.ids[i]))
                out["n_bytes"].append(hi - lo)
                out["n_removed"].append(k)
                out["n_spans"].append(int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if k else 0)
                out["kept_sha256"].append(hashlib.sha256(data[lo:hi][~c].tobytes() if k else found.texts[i]).hexdigest())
        return pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})

    by_block = blocks.groupBy("block")
    shared = by_block.applyInArrow(send_owners, ROUTED).groupBy("bucket").applyInArrow(find_shared, ROUTED).select("block", "bucket", "kind", "data")
    earlier = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_runs, ROUTED).groupBy("bucket").applyInArrow(order_runs, ROUTED).select("block", "bucket", "kind", "data")
    return by_block.cogroup(shared.unionByName(earlier).groupBy("block")).applyInArrow(cut_texts, RESULT)


#: The contract in DuckDB, on hexadecimal texts cut into pieces of 500 places, so that no string is long.
ORACLE = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, (length(h) // 2)::BIGINT AS n FROM documents),
pieces AS (SELECT r, doc_id, p, substr(h, 1000 * p + 1, 1098) AS piece, least(500, n - 49 - 500 * p) AS many FROM (SELECT *, unnest(range(0, (n - 49 + 499) // 500)) AS p FROM d WHERE n >= 50)),
strings AS MATERIALIZED (SELECT r, doc_id, 500 * p + i AS pos, substr(piece, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, many)) AS i FROM pieces)),
first_ AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT r, pos FROM strings JOIN first_ USING (s) WHERE m < doc_id),
marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM gone WINDOW w AS (PARTITION BY r ORDER BY pos)),
runs AS (SELECT r, run, min(pos) AS lo, max(pos) + 50 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY pos) AS run FROM marked) GROUP BY r, run),
gaps AS (SELECT r, run, hi, hi - lo AS removed, substr(h, 2 * coalesce(lag(hi) OVER w, 0) + 1, 2 * (lo - coalesce(lag(hi) OVER w, 0))) AS gap FROM runs JOIN d USING (r) WINDOW w AS (PARTITION BY r ORDER BY run)),
cut AS (SELECT r, sum(removed)::BIGINT AS removed, count(*) AS spans, max(hi) AS hi, string_agg(gap, '' ORDER BY run) AS kept FROM gaps GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE kept || substr(h, 2 * hi + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
