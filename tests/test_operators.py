"""Edges of the reference's operators on literal rows."""

import json
import random

import pytest
from evidloom.functions import records, text, vectors
from evidloom.operators import align, answering, backends, collection, flatten, registry, retrieval, sessions, slicer
from evidloom.streaming import assets
from pyspark.sql import functions as F


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, data, schema, column):
    return [r[0] for r in spark.createDataFrame(data, schema).coalesce(1).select(column).collect()]


def test_text(spark):
    t = lambda data, c: one(spark, [(x,) for x in data], "x string", c)
    x = F.col("x")
    assert t(["　 a b \t", "", None], text.stripped(x)) == ["a b", "", None]
    assert t(["12.5", "12.509", "x", None, "12.52"], text.close_to(x, 12.5)) == [True, True, False, False, False]
    assert t(["Abc", "", None], text.contains_folded(x, F.lit(""))) == [True, True, False]
    assert t(["a.PDF", "b.mp4", "c.avi", "d"], text.asset_type(x)) == ["pdf", "video", None, None]
    assert t(["/v/time_12.50.jpg", "time_x.jpg", "other.jpg", "time_1.2.3.jpg"], text.frame_seconds(x)) == [12.5, None, None, None]
    assert t(["[0, 1, 2, 3]", "null", "[1]", None], text.scaled_box(x, 595.28)) == [[0, 1, 2, 3], None, None, None]
    assert t(['```json\n{"a": 1}\n```', "{}"], text.unfenced(x)) == ['{"a": 1}', "{}"]
    assert t(["a long first message"], text.session_name(x)) == ["Chat-a long first"]
    assert one(spark, [(75.9,), (0.0,), (3600.0,)], "x double", text.minutes(x)) == ["1:15", "0:00", "60:00"]
    assert one(spark, [([], [1]), (None, [2]), ([3], None), ([], None)], "a array<int>, b array<int>", text.first_full(F.col("a"), F.col("b"))) == [[1], [2], [3], []]
    assert len(one(spark, [(1,)], "x int", text.session_id())[0]) == 11


def test_records(spark):
    t = lambda data, c: one(spark, [(x,) for x in data], "x string", c)
    x = F.col("x")
    got = t(['log\n{"a": 1}\n', "log\nnot json", ""], records.last_line_record(x, "a int"))
    assert [(r.status, r.data and r.data.a) for r in got] == [("success", 1), ("partial_success", None), ("partial_success", None)]
    assert t(["SUCCESS|a:1|b:2:3", "FAILED|a:1"], records.piped(x)) == [{"a": "1", "b": "2"}, None]
    assert t(["x<<a\nb>>c", "<<a", "a>>", None], records.between(x, "<<", ">>")) == ["a\nb", None, None, None]
    lines = [("c", i, s) for i, s in enumerate(["data: " + json.dumps({"choices": [{"delta": {"content": "He"}}]}), ": ping", "data: " + json.dumps({"choices": [{"delta": {"content": "y"}}]}), "data: [DONE]", "data: " + json.dumps({"choices": [{"delta": {"content": "late"}}]})])]
    df = records.deltas(spark.createDataFrame(lines, "k string, n int, line string"), "k", "n", "line")
    assert values(sessions.said(df, "k", "n", "delta")) == [("c", "Hey")]


def test_vectors(spark):
    assert one(spark, [([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>", vectors.l2_normalized(F.col("v"))) == [[0.6, 0.8], [0.0, 0.0]]
    assert one(spark, [([1.0], [2.0, 3.0]), (None, [1.0]), ([2.0], [3.0])], "a array<double>, b array<double>", vectors.dot(F.col("a"), F.col("b"))) == [None, None, 6.0]
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "k string, v array<float>")
    assert values(vectors.collected(vectors.mean_pooled(df, "k", "v"), "k")) == [("a", [2.0, 3.0]), ("b", [5.0, 6.0])]


def test_means(spark, monkeypatch):
    data = [("a", [1.0, None, 3.0]), ("a", [2.0, None]), ("a", None), (None, [5.0]), (None, [7.0]), ("b", []), ("c", [float("inf"), 1.0]), ("hot", [0.1, 0.2])] + [("hot", [float(i), 1.0]) for i in range(500)]
    df = spark.createDataFrame(data, "key string, v array<double>").repartition(5)
    want = [(None, 0, 6.0), ("a", 0, 1.5), ("a", 1, None), ("a", 2, 3.0), ("c", 0, float("inf")), ("c", 1, 1.0)]
    for held in (1 << 20, 1):
        monkeypatch.setattr(vectors, "HELD", held)
        got = vectors.mean_pooled(df, "key", "v")
        assert values(got.filter("key is null or key <> 'hot'")) == sorted(want, key=str)
        assert [round(r.mean, 9) for r in got.filter("key = 'hot'").orderBy("position").collect()] == [round((0.1 + 500 * 499 / 2) / 501, 9), round((0.2 + 500) / 501, 9)]
    assert vectors.mean_pooled(df.limit(0), "key", "v").collect() == []


def coll(spark, rows):
    full = [(i, [b, 0.0], a, m, c, t, r, "null") for i, b, a, m, c, t, r in rows]
    df = spark.createDataFrame(full, "id long, vector array<float>, asset_name string, modality string, content_type string, timestamp double, content_ref string, coordinates string")
    return df.select("id", "vector"), df.drop("vector")


def test_rerank(spark):
    rows = [(i, 0.5, "none", "video", "image_frame", 9.0, "nothing") for i in range(40)] + [(100, 0.25, "Src1.pdf", "pdf", "title", 3.0, "THE end")]
    v, d = coll(spark, rows)
    prefer = retrieval.Preferences("src1", "pdf", 3.005)
    outside = retrieval.hybrid_topk(v, d, [1.0, 0.0], "the", prefer, k=8)
    assert [r.id for r in outside.collect()] == list(range(8))  # row 41 of 40 can't be promoted
    inside = retrieval.hybrid_topk(v, d, [1.0, 0.0], "the", prefer, k=9).first()
    assert (inside.id, inside.score, inside.base_score) == (100, 1.55, 0.25)
    empty = retrieval.hybrid_topk(v, d, [1.0, 0.0], "", k=2).collect()
    assert [(r.id, r.score) for r in empty] == [(0, 0.65), (1, 0.65)]  # the empty question is in every text
    row = retrieval.evidence(retrieval.hybrid_topk(v, d, [1.0, 0.0], "the", prefer, k=9)).first()
    assert row.metadata.page_label == 3 and row.metadata.timestamp is None and row.content == "THE end"


def test_answering(spark):
    v, d = coll(spark, [(1, 0.5, "a", "pdf", "text", 1.0, "x")])
    seen = []
    found, states = answering.searched(lambda i: retrieval.hybrid_topk(v, d, [1.0, 0.0], "x"), lambda hits: seen.append(1) or "refetch")
    assert len(seen) == 2 and found.count() == 2 and states.count("Researching") == 2 and states[-1] == "Idle"
    found, _ = answering.searched(lambda i: retrieval.hybrid_topk(v, d, [1.0, 0.0], "x"), lambda hits: "proceed")
    assert found.count() == 1


def test_alignment(spark):
    rng = random.Random(4)
    frames = [("a", 100.0, 1), ("a", 500.0, 2), ("b", 0.0, 3)] + [(rng.choice("ab"), rng.uniform(0, 900), 10 + i) for i in range(60)]
    segments = [("a", 90.0, 95.0, 1, " starts "), ("a", 115.0, 118.0, 2, "ends"), ("a", 115.1, 119.0, 3, "late")] + [(rng.choice("ab"), s := rng.uniform(-50, 900), s + rng.choice([0, 1, 30, 2000]), 10 + i, "w") for i in range(80)]
    f = spark.createDataFrame(frames, "asset string, ts double, frame_id long")
    s = spark.createDataFrame(segments, "asset string, start double, end double, segment_id long, text string")
    cols = ("asset", "frame_id", "segment_id")
    assert values(align.overlap_pairs(f, s).select(*cols)) == values(align.theta_pairs(f, s).select(*cols))
    got = {r.frame_id: r for r in align.aligned(f.filter("frame_id < 10"), s.filter("segment_id < 10")).collect()}
    assert (got[1].content, got[1].need_vision) == ("starts ends", True)
    assert got[2].content == "" and set(got) == {1, 2, 3}
    assert align.aligned(f.limit(0), s).collect() == []


def test_slicer(spark):
    rows = [("a", float(t), t, x) for t, x in [(0, 0.0), (1, 0.5), (11, 0.5), (12, 1.0), (22, 0.5), (23, 1.0), (40, 1.03125)]] + [("b", 0.0, 1, 1.0), (None, 5.0, 1, 1.0)]
    df = spark.createDataFrame(rows, "asset string, ts double, frame_id long, signal double")
    kept = values(slicer.greedy_throttle(df).select("asset", "frame_id"))
    assert kept == [("a", 0), ("a", 1), ("a", 12), ("a", 23), ("a", 40), ("b", 1), (None, 1)]
    assert values(slicer.greedy_throttle(df, change=0.5).select("asset", "frame_id")) == [("a", 0), ("b", 1), (None, 1)]  # equal isn't over
    many = spark.createDataFrame([("c", i / 2, i, 0.0) for i in range(100)], "asset string, ts double, frame_id long, signal double")
    assert [r[1] for r in values(slicer.uniform(many).select("asset", "frame_id"))] == [0, 20, 40, 60, 80]
    assert slicer.key_frames(many).count() == 5  # too few changes
    assert slicer.strided(many.withColumn("frame_no", F.col("frame_id")), 25.0).count() == 9
    assert slicer.strided(many.withColumn("frame_no", F.col("frame_id")), 1.0).count() == 100


def test_flatten(spark):
    span = lambda c, p=None: {"type": "t", "content": c, "image_path": p}
    block = lambda **k: {"type": None, "bbox": [0.0, 1.0, 2.0, 3.0], "blocks": None, "lines": None, "text": None, "text_content": None} | k
    blocks = [
        block(type="image", blocks=[{"lines": [{"spans": [span("Fig ", "/x/one.jpg"), span("1", "/x/two.jpg")]}]}]),
        block(type="text", lines=[{"spans": [span("ab"), span("cd")]}]),
        block(type="title", lines=[{"spans": [span("　abcde　")]}]),
        block(type="text", text="given text", lines=[]),
        block(type="table", blocks=[{"lines": [{"spans": [span("T" * 60, "/y/two.jpg")]}]}]),
    ]
    page = {"preproc_blocks": [], "middle_blocks": blocks}
    df = spark.createDataFrame([("d", [], [page])], f"asset string, {flatten.PARSED}")
    found = flatten.blocks(df)
    assert values(flatten.chunks(found).select("block_idx", "text")) == [(2, "abcde"), (3, "given text")]
    last = flatten.images(found).collect()
    assert [(r.name, len(r.text_slice), r.place.block_idx) for r in last] == [("two.jpg", 50, 0)]
    files = spark.createDataFrame([("d", "two.jpg", 0)], "asset string, name string, length long")
    assert flatten.images(found, files).count() == 0


def test_collection(spark):
    v = [1.0]
    features = spark.createDataFrame([("a", 1.0, "f1", v, v, "x" * 600), ("a", 2.0, "f2", None, v, "t"), ("a", 3.0, "f3", v, [], "t"), ("a", 4.0, "f4", None, None, "t")], "asset string, timestamp double, frame_name string, img_vector array<float>, text_vector array<float>, content string")
    rows = collection.video_rows(features)
    assert rows.count() == 4 and max(len(r.content_ref) for r in rows.collect()) == 500
    assert collection.with_ids(rows).select("id").distinct().count() == 4
    assert values(collection.counts(rows)) == [("a", 4)]


def test_sessions(spark):
    rows = [("c", i, "user", f"m{i}") for i in range(8)] + [("d", 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in sessions.context(df).collect()}
    assert got["c"].history.split("\n")[0] == "user: m2" and got["c"].n_messages == 6 and got["d"].history == "user: only"
    states = spark.createDataFrame([("k", i, s) for i, s in enumerate(["a", "a", None, None, "b", "a"])], "k string, n int, s string")
    assert [r.n for r in sessions.changed(states, "k", ["n"], "s").orderBy("n").collect()] == [0, 2, 4, 5]
    assert [r.is_last for r in sessions.last_flag(states, "k", ["n"]).orderBy("n").collect()] == [False] * 5 + [True]
    assert values(sessions.reset(spark.createDataFrame([("FAILED",), ("Researching",)], "status string"))) == [("FAILED",), ("Idle",)]


def test_registry(spark):
    df = spark.createDataFrame([("a", "Raw", "2"), ("b", "Uploading", "1"), ("a", "Raw", "3")], "asset_id string, status string, created_at string")
    assert registry.global_state(df).first().state == "Uploading" and registry.global_state(df, "a").first().state == "Handling"
    assert registry.global_state(df.limit(0)).first().state == "Waiting"
    assert registry.sessions_state(df).first().state == "Querying"
    assert values(registry.queued(df)) == [("a", "2")]
    assert registry.lookup(df, "asset_id", "zz").count() == 0 and registry.lookup(df, "asset_id").count() == 3
    shown = registry.instructions(spark.createDataFrame([("x",), (None,)], "strategy string"), {"x": "look", "scene_description": "tell"})
    assert sorted(r.instruction for r in shown.collect()) == ["look", "tell"]
    over = one(spark, [({"a": "1", "b": "2"}, {"b": "3"})], "d map<string,string>, g map<string,string>", registry.overlaid(F.col("d"), F.col("g")))
    assert over == [{"a": "1", "b": "3"}]


@pytest.mark.parametrize(("expression", "value"), [("2*(3+4)", 14.0), ("sqrt(16)", 4.0), ("__import__('os')", None), ("1/0", None), ("9**9**9", None), ("x", None), ("-pi", -3.141592653589793)])
def test_calculator(expression, value):
    assert backends.evaluated(expression) == value


def test_backends(spark):
    df = spark.createDataFrame([("a", True), ("", True), ("b", False), (None, None)], "t string, g boolean")
    got = {r.t: r.vector for r in backends.embedded(df, "t").collect()}
    assert got[""] is None and got[None] is None and len(got["a"]) == backends.DIMENSION
    assert {r.t: r.answer for r in backends.answered(df, "t", F.col("g")).collect()} == {"a": "a", "": "", "b": None, None: None}
    assert {r.t: r.result for r in backends.calculated(spark.createDataFrame([("1+1",), ("empty",), ("",), (None,), ("no",)], "t string"), "t").collect()} == {"1+1": 2.0, "empty": None, "": None, None: None, "no": None}
    assert one(spark, [({"__a": 1, "b": 2},)], "m map<string,int>", backends.public_fields(F.col("m"))) == [{"b": 2}]
    assert one(spark, [("h",)], "h string", backends.rendered("Q: {{ h }}!", h=F.col("h"))) == ["Q: h!"]


def test_states(spark):
    df = spark.createDataFrame([("a", "Raw"), ("b", "Raw"), ("c", "Ready"), ("d", "Failed")], "asset_id string, status string")
    steps = {"Cliping": lambda rows: rows.withColumn("failed", F.col("asset_id") == "b")}
    assert values(assets.advanced(df, steps)) == [("a", "Ready"), ("b", "Failed"), ("c", "Ready"), ("d", "Failed")]
