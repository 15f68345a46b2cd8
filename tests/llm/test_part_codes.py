import hashlib
import math
import random

import numpy as np
import pytest
from evidloom.llm import catalog, part_codes
from evidloom.llm.common import table
from oracle import check
from pyspark.sql import functions as F


def test_contract(spark):
    check(catalog.op13_part_codes(spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", part_codes.ORACLE)


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain loops over Python's integers; rows are (id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and v]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    w = len(kept[0][1]) // parts
    cut = [[r[1][w * p : w * p + w] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for i, xs in of.items():
                books[p][i] = [sum(col) // len(xs) for col in zip(*xs)]
    got = [(r[0], [near(c[p], books[p]) for p in range(parts)], r[2]) for r, c in zip(kept, cut)]
    by_label = {}
    for _, m, lab in got:
        by_label[lab] = by_label.get(lab, 0) + sum(d for d, _ in m)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in m), sum(d for d, _ in m), by_label[lab]) for i, m, lab in got), key=str), sha


SCHEMA = "_label string, vec_id long, embedding array<double>, label int"


def frame(spark, rows):
    return spark.createDataFrame([("x", i, v, lab) for i, v, lab in rows], SCHEMA).repartition(5)


def found(df):
    codes, books = part_codes.compress(df)
    return sorted((tuple(r) for r in codes.collect()), key=str), books.sha256()


def test_edges(spark):
    r = random.Random(3)
    vec = lambda: [r.choice((-1.5, -0.3, 0.0, 0.25, 0.7)) * r.choice((1, 1, 1.001)) for _ in range(8)]
    rows = [(i, vec(), r.choice((1, 2, None))) for i in range(600)]
    rows += [(700 + i, [0.5] * 8, 1) for i in range(300)]  # one vector for a third of the rows
    rows += [(900 + i, [0.5] * 4 + vec()[:4], None) for i in range(100)]
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (None, vec(), 2), (None, None, 2), (2000, None, 1), (2001, [None] * 8, 1), (2002, [math.nan] * 8, 1), (2003, [math.inf] + [0.0] * 7, 1), (2004, [1000.0] * 8, 3), (2005, [-100000.0] * 8, 3)]
    assert found(frame(spark, rows)) == brute(rows)
    odd = [(3000, [1.0] * 4, 1), (3001, [1.0] * 9, 1), (3002, [], 1), (3003, [1e30] * 8, 1)]  # other lengths and what is too large
    assert found(frame(spark, rows + odd)) == brute(rows)
    few = [(i, [0.1 * i, -0.1 * i, 1.0, 1.0], None) for i in range(3)]
    assert found(frame(spark, few)) == brute(few)
    same = [(i, [0.25] * 4, i % 2) for i in range(300)]  # ties: all entries are equal, the first takes all
    assert found(frame(spark, same)) == brute(same) and {c for _, c, _, _ in found(frame(spark, same))[0]} == {"00000000"}
    assert found(frame(spark, few).limit(0)) == ([], hashlib.sha256(b"").hexdigest())


def test_real_vectors(spark):
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in table(spark, "/root/testdata/sf0.001", "embeddings").collect()]
    assert found(frame(spark, rows)) == brute(rows)


def test_large_components_take_the_slow_way():
    g = np.random.default_rng(1)
    rows, entries = g.integers(-(1 << 27), 1 << 27, (70, 6)), g.integers(-(1 << 27), 1 << 27, (9, 6))
    at, error = part_codes.nearest(rows, entries)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(entries)) for x in rows]
    assert list(zip(error.tolist(), at.tolist())) == want


def test_decoding(spark):
    own = table(spark, "/root/testdata/sf0.01", "embeddings")
    codes, books = part_codes.compress(own)
    both = part_codes.decoded(codes, books).join(own, "vec_id").select(F.col("vector"), F.col("embedding").cast("array<double>").alias("x"), "error").collect()
    assert len(both) == 500
    for r in both:  # the middle of each step is at most half a step in each component from the integer's
        assert abs(np.linalg.norm(np.array(r.vector) - r.x) - math.sqrt(r.error) / 1024) <= 64**0.5 / 1024
    assert np.mean([np.linalg.norm(np.array(r.vector) - r.x) for r in both]) < 0.6


@pytest.mark.parametrize("entries", [3, 300])
def test_other_sizes(spark, entries):
    r = random.Random(4)
    rows = [(i, [r.random() for _ in range(6)], 1) for i in range(400)]
    codes, books = part_codes.compress(frame(spark, rows), parts=2, entries=entries, rounds=2)
    want, _ = brute(rows, 2, entries, 2)
    assert sorted((x.vec_id, x.error) for x in codes.collect()) == sorted((i, e) for i, _, e, _ in want)
    assert {len(x.code) for x in codes.collect()} == {4 if entries < 256 else 6}
