import random
from datetime import datetime, timedelta

import pytest
from evidloom.operators import sessions
from evidloom.streaming import keyed
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
EVENTS = "asset_id string, event_id long, event string, asset_type string, at timestamp"


def at(seconds):
    return START + timedelta(seconds=seconds)


def streamed(spark, tmp_path, files, schema, transform, stops=1):
    """All files through the stream, one a batch; the query is started anew after each of ``stops`` shares of them."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    share = -(-len(files) // stops)
    for k in range(0, len(files), share):
        for rows in files[k : k + share]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
    return spark.read.parquet(out)


def dealt(rows, when, parts, late, seed):
    """Rows in ``parts`` files, each row at most ``late`` seconds after its time would have it."""
    r = random.Random(seed)
    order = sorted(rows, key=lambda x: x[when] + timedelta(seconds=r.random() * late))
    size = -(-len(order) // parts)
    out = [order[i : i + size] for i in range(0, len(order), size)]
    for p in out:
        r.shuffle(p)
    return out


def course(r, asset, kind):
    t, rows, quick = r.random() * 5000, [], r.random() < 0.4
    for i in range(9 if quick else r.randrange(1, 9)):
        rows.append((asset, i, r.choice(("done",) * 8 + ("failed", "ping")), kind, at(t)))
        t += r.choice((0.0, 100.0, 900.0) if quick else (0.0, 100.0, 900.0, 1199.0, 1500.0, 3599.0, 3600.0, 3700.0))
    return rows


def test_assets_stream_equals_table(spark, tmp_path):
    r = random.Random(4)
    rows = [x for i in range(40) for x in course(r, f"a{i}", r.choice(("pdf", "video", None)))]
    files = dealt(rows, 4, 5, 3000, 1) + [[("end", 0, "done", "pdf", at(400_000))]]
    found = streamed(spark, tmp_path, files, EVENTS, lambda s: keyed.asset_changes(s, "1 hour"), stops=3)
    table = keyed.asset_history(spark.createDataFrame(rows, EVENTS), F.lit(at(390_000)))
    got, want = (sorted(map(tuple, d.filter("asset_id <> 'end'").collect())) for d in (found, table))
    assert (set(got) - set(want), set(want) - set(got), len(got)) == (set(), set(), len(want)) and {x[3] for x in want} == {"done", "failed", "timeout"} and "Ready" in {x[1] for x in want}


def test_assets_by_hand(spark):
    rows = [("late", 0, "done", "pdf", at(0)), ("late", 1, "done", "pdf", at(10)), ("late", 2, "done", "pdf", at(1211)), ("edge", 0, "done", "pdf", at(0)), ("edge", 1, "done", "pdf", at(10)), ("edge", 2, "done", "pdf", at(1210)), ("wait", 0, "done", "video", at(0)), ("wait", 1, "done", "video", at(5)), ("none", 0, "ping", None, at(0)), (None, 1, "failed", None, at(0)), ("x", 1, "done", None, None)]
    df = spark.createDataFrame(rows, EVENTS)
    got = sorted(((a, s, int((t - START).total_seconds()), w) for a, s, t, w in keyed.asset_history(df, F.lit(at(1900))).collect()), key=str)
    assert got == sorted([("late", "Raw", 0, "done"), ("late", "recognizing", 10, "done"), ("late", "Failed", 1210, "timeout"), ("edge", "Raw", 0, "done"), ("edge", "recognizing", 10, "done"), ("edge", "Cliping", 1210, "done"), ("wait", "Raw", 0, "done"), ("wait", "recognizing", 5, "done"), ("wait", "Failed", 1805, "timeout"), (None, "Failed", 0, "failed")], key=str)
    assert keyed.asset_history(df).filter("asset_id = 'wait' and status = 'Failed'").count() == 0  # not known yet


def test_changes_stream_equals_table(spark, tmp_path):
    own = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).collect()
    rows = [tuple(x) for x in own] + [(7, 10_000, None, at(86400)), (7, 10_001, None, at(86401))]
    schema = "user_id long, event_id long, event_type string, ts timestamp"
    files = dealt(rows, 3, 4, 86400, 2) + [[(-1, 0, "end", at(86400 * 90))]]
    found = streamed(spark, tmp_path, files, schema, lambda s: keyed.status_changes(s, "user_id", "event_id", "event_type", delay="2 days"), stops=2)
    want = sessions.changed(spark.createDataFrame(rows, schema), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "ts", "event_type")
    assert sorted(map(tuple, found.filter("user_id >= 0").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_late_rows_and_forgotten_keys(spark, tmp_path):
    schema = "k string, n long, s string, ts timestamp"
    files = [
        [("a", 1, "x", at(0)), ("b", 1, "x", at(0))],
        [("a", 2, "x", at(1000)), ("c", 1, "x", at(5000))],
        [("b", 2, "x", at(6000))],  # b was silent for over an hour
        [("a", 3, "y", at(10)), ("c", 2, "x", at(50_000))],  # 10 is long past the watermark
        [("a", 4, "x", at(60_000))],
        [("end", 1, "x", at(200_000))],
    ]
    found = streamed(spark, tmp_path, files, schema, lambda s: keyed.status_changes(s, "k", "n", "s", delay="10 seconds", forget=3600))
    assert sorted((r.k, r.n) for r in found.filter("k <> 'end'").collect()) == [("a", 1), ("a", 4), ("b", 1), ("b", 2), ("c", 1), ("c", 2)]


@pytest.mark.parametrize("gap", [3600, 3601])
def test_fold_alone(gap):
    fold = keyed.asset_fold(keyed.LIMITS)
    state, made = None, []
    for n, t in enumerate((0, 1, 2, 2 + gap)):
        more, state = fold(state, (t * keyed.SECOND, n, "done", "pdf"), 0)
        made += more
    assert made[-1][0] == ("Structuring" if gap == 3600 else "Failed")
