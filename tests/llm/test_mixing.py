import random
from collections import defaultdict

import pytest
from evidloom.llm import catalog, mixing
from evidloom.llm.common import table
from pyspark.sql import functions as F


def wanted(sizes):
    """Targets by sharing again and again, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= over
    return target


def holds(rows, words):
    sizes, longest = defaultdict(int), defaultdict(int)
    for d, s, n in words:
        sizes[s] += n
        longest[s] = max(longest[s], n)
    target, taken = wanted(sizes), defaultdict(int)
    source = {d: s for d, s, _ in words}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size and len(r.shards) == (r.taken // r.size if r.size else len(r.shards))
        taken[s] += r.taken
    for s, t in target.items():
        assert t - longest[s] <= taken[s] <= t + 1e-6


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_contract(spark, sf):
    d = f"/root/testdata/sf{sf}"
    words = [(r.doc_id, r.source, len(r.text.split())) for r in table(spark, d, "documents").collect()]
    rows = catalog.op3_mix_sources(spark, d).collect()
    assert len(rows) == len(words)
    holds(rows, words)
    assert sorted(map(str, rows)) == sorted(map(str, catalog.op3_mix_sources(spark, d).collect()))


def test_edges(spark):
    rng = random.Random(1)
    texts = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", "é", "", None, "hot", "hot", "hot"]), 1) for i in range(300)] + [(900, None, "empty", 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, shard int")
    holds(mixing.taken(df, blocks=8).collect(), [(d, s, len((t or "").split())) for d, t, s, _ in texts])
    mix = mixing.mixed(df, blocks=8)
    assert mix.columns == ["doc_id", "text", "source", "shard", "shard_", "place"]
    count = {r.doc_id: r.n for r in mix.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert count == {r.doc_id: len(r.shards) for r in mixing.taken(df, blocks=8).collect() if r.shards}
    assert mixing.shuffled(mix, "shard_").count() == mix.count()
    assert mixing.taken(df.limit(0)).collect() == []


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (1, "d e", "s"), (1, "d e", "s"), (1, "d e", None), (2, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    got = mixing.taken(df, blocks=4).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 2, 2, 3, 3]
    assert len({r.taken for r in got if r["size"] == 3}) == 1  # equal rows are taken alike
    target = {10: None, 2: None}
    for r in got:
        target[r.source_size] = r.target
    assert target == pytest.approx(wanted({"s": 10, None: 2}) and {10: wanted({"s": 10, None: 2})["s"], 2: wanted({"s": 10, None: 2})[None]})
    for of in (10, 2):
        assert target[of] - 6 <= sum(r.taken for r in got if r.source_size == of) <= target[of] + 1e-6


def test_tree(spark):
    quotas = {0: 3000, 1: 0, 2: 5, 3: 411, 4: 1}
    df = spark.createDataFrame(list(quotas.items()), "source_no int, n long")
    for shards in (1, 5, 16):
        got = defaultdict(dict)
        for r in mixing.split_tree(df, shards).collect():
            got[r.shard][r.source_no] = r.n
        assert sorted(got) == list(range(shards)) and all(n >= 0 for q in got.values() for n in q.values())
        assert {s: sum(q[s] for q in got.values()) for s in quotas} == quotas
        sums = [sum(q.values()) for q in got.values()]
        assert max(sums) - min(sums) <= 5


def test_hypergeometric(spark):
    from math import comb

    total, good, draws = 40, 13, 17
    us = [(i + 0.5) / 4000 for i in range(4000)]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.hypergeometric(F.lit(total), F.lit(good), F.lit(draws), F.col("u"))).collect()]
    for x in range(14):
        p = comb(good, x) * comb(total - good, draws - x) / comb(total, draws)
        assert abs(got.count(x) / 4000 - p) < 1e-3
