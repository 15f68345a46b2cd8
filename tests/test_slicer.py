import random

import numpy as np
import pytest
from evidloom.operators import slicer
from evidloom.plans import catalog
from oracle import check

SCHEMA = "asset string, ts double, frame_id long, signal double"


def brute(rows, change=slicer.CHANGE, gap=slicer.GAP):
    """Kept frames, and those with the uniform sample besides, by a plain loop."""
    kept, both = [], []
    by_asset = {}
    for r in rows:
        if r[1] is not None:
            by_asset.setdefault(r[0], []).append(r)
    for asset, own in by_asset.items():
        own.sort(key=lambda r: (r[1], r[2]))
        last, before, found = -gap, None, []
        for i, (_, t, f, x) in enumerate(own):
            if i == 0 or (x is not None and before is not None and abs(x - before) > change and t - last > gap):
                found.append(f)
                last = t if i else last
            before = x
        goal = max(int(own[-1][1] // slicer.SECONDS_EACH), slicer.LEAST)
        step = max(len(own) // goal, 1)
        sample = [r[2] for i, r in enumerate(own) if i % step == 0 and i < step * goal] if len(found) < goal else []
        kept += [(asset, f) for f in found]
        both += [(asset, f) for f in {*found, *sample}]
    return sorted(kept, key=str), sorted(both, key=str)


def values(df):
    return sorted(((r.asset, r.frame_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("parts", "spread"), [(1, 1.0), (3, 0.3), (23, 7.0), (40, 0.05)])
def test_equals_a_loop(spark, parts, spread):
    """One asset has most rows and goes over many ranges, others share one; times repeat; signals are missing."""
    r = random.Random(parts)
    rows = []
    for asset, n in (("hot", 900), ("b", 60), ("c", 1), (None, 40), ("d", 300)):
        t, many = (-25.0 if asset == "d" else 0.0), []
        for i in range(n):
            t += r.choice((0.0, spread, spread * r.random(), 10.0 if r.random() < 0.05 else 0.0))
            many.append((asset, t, i, r.choice((0.0, 0.01, 0.5, 1.0, None))))
        rows += many
    rows.append(("b", None, 1000, 0.5))
    r.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        kept, both = brute(rows)
        found = slicer.pieces(df)
        assert found.filter("piece is not null and asset = 'hot'").count() >= min(parts, 10) // 2
        assert values(slicer.greedy_throttle(df)) == kept
        assert values(slicer.key_frames(df)) == both
        share = [x.n for x in found.filter("piece is null").groupBy("block").count().withColumnRenamed("count", "n").collect()]
        assert max(share) < 10 * np.median(share) or parts == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chains_by_pointer_doubling():
    r = random.Random(9)
    for n in (1, 2, 3, 50):
        for _ in range(40):
            times, t = [], r.choice((-30.0, 0.0, 5.0))
            for _ in range(n):
                t += r.choice((0.0, 0.1, 3.3, 9.9, 10.0, 10.1, 25.0))
                times.append(t)
            found = slicer.chains(np.array(times), 10.0)
            for last in [max(times[0], -10.0) - x for x in (0.0, 0.05, 1.0, 5.0, 9.95, 10.0, 30.0)]:
                end, kept = last, 0
                for x in times[1:]:
                    if x - end > 10.0:
                        end, kept = x, kept + 1
                run = next((x for x in found.runs if x[0] - last > 10.0), (None, last, 0))
                assert (run[1], run[2]) == (end, kept)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert slicer.greedy_throttle(df).collect() == slicer.key_frames(df).collect() == slicer.uniform(df).collect() == []


def test_exchanges(spark):
    """Beside the range that ``pieces`` writes: one by block for frames and for states each, and one by asset for pieces."""
    plan = slicer.key_frames(catalog._signal(spark, "/root/testdata/sf0.1"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Window" not in plan


@pytest.mark.parametrize("name", ["slicer_keep", "key_frames", "uniform_fallback"])
def test_larger_table(spark, name):
    check(catalog.queries()[name](spark, "/root/testdata/sf0.1"), "/root/testdata/sf0.1", catalog.oracle_sql()[name])
