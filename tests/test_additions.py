"""Edges of prompts, formulas, outlines, feature files and a question's course."""

import json

import pytest
from evidloom.functions import text
from evidloom.operators import answering, backends, collection, outline, registry, retrieval, sessions
from evidloom.sources import readers, writers
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


def row(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_templates(spark, tmp_path):
    docs = F.array(F.struct(F.lit("a").alias("t")), F.struct(F.lit(None).cast("string").alias("t")))
    assert row(spark, backends.rendered("{% for d in docs %}{{ loop.index }}:{{ d.t }};{% endfor %}", docs=docs)) == "1:a;2:;"
    for value, want in ((F.lit(""), "no"), (F.lit("x"), "yes x"), (F.lit(None), "no"), (F.lit(0), "no"), (F.lit(False), "no"), (F.lit(True), "yes true")):
        assert row(spark, backends.rendered("{% if v %}yes {{ v }}{% else %}no{% endif %}", v=value)) == want
    assert row(spark, backends.rendered('{{ v if v else "none" }} {{ "a" if v else "b" }} {{ other }}|', v=F.lit(None))) == "none b |"
    nested = "{% for d in docs %}{% if d.t %}<{{ d.t }}>{% endif %}{% endfor %}"
    assert row(spark, backends.rendered(nested, docs=docs)) == "<a>"
    for wrong in ("{% if v %}x", "{% while v %}"):
        with pytest.raises(ValueError):
            backends.rendered(wrong, v=F.lit(1))
    (tmp_path / "b.jinja2").write_text("B {{ q }}")
    (tmp_path / "a.jinja2").write_text("A")
    assert [tuple(r) for r in backends.templates(spark, str(tmp_path)).collect()] == [("a", "A"), ("b", "B {{ q }}")]


def test_formulas(spark):
    assert backends.solved("x**2 - 5*x + 6") == ["2", "3"] and backends.solved("2*x + 3 = 0") == ["-\\frac{3}{2}"]
    assert backends.solved("x**2 - 2") == ["- \\sqrt{2}", "\\sqrt{2}"] and backends.solved("t**2 + 2*t + 5", "t") == ["-1 - 2 i", "-1 + 2 i"]
    assert backends.simplified("(x + 1)**2 - x**2 - 1") == "2 x" and backends.simplified("x - x") == "0"
    assert backends.scripted("a = 2\nb = a * 3 + 1\n__c = 1") == {"a": "2.0", "b": "7.0"}
    data = [("x**3", "solve"), ("import os", "script"), ("a = b", "script"), ("1/0", "eval"), (None, "eval"), ("2*3", "eval"), ("x", None), ("x**999999", "simplify"), ("y + 1", "simplify")]
    got = backends.reckoned(spark.createDataFrame([(i, *d, None) for i, d in enumerate(data)], "i int, expression string, mode string, symbol string")).orderBy("i").collect()
    assert [r.result["values"] for r in got] == [None, None, None, None, None, {"0": "6.0"}, None, None, None]
    assert all((r.result["values"] is None) != (r.result["error"] is None) for r in got)
    assert backends.reckoned(spark.createDataFrame([], "expression string, mode string, symbol string")).collect() == []


def test_transcripts_and_outlines(spark, tmp_path):
    videos = spark.createDataFrame([("v", "/v.mp4"), ("silent", "/s.mp4")], "asset string, path string")
    heard = backends.transcribed(videos, lambda path: [(0.123, 1.0, " one "), (1.0, 2.5, "two")] if path == "/v.mp4" else [])
    assert sorted(map(tuple, heard.collect())) == [("v", 0.12, 1.0, 0, "one"), ("v", 1.0, 2.5, 1, "two")]
    contexts = outline.transcript_context(heard).withColumn("asset_type", F.lit("video"))
    assert contexts.first().context == "[0.12s]: one\n[1.0s]: two"
    long = outline.document_context(spark.createDataFrame([("d", "x" * 60_000)], "asset string, content string"))
    assert len(long.first().context) == outline.CONTEXT
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "d_content_list.json").write_text('[{"text": "hi"}]')
    assert [tuple(r) for r in readers.content_lists(spark, str(tmp_path / "d")).collect()] == [("d", '[{"text": "hi"}]')]
    said = {"title": "T", "outline": [{"heading": "h", "anchor": 1.5, "summary": "s", "sub_points": [{"heading": "p", "anchor": 2.0, "summary": "q"}]}]}
    answer = lambda prompts: ["```json\n" + json.dumps(said) + "\n```" if "one" in p else "sorry" for p in prompts]
    two = contexts.unionByName(spark.createDataFrame([("w", "nothing", "video")], "asset string, context string, asset_type string"))
    made = outline.outlined(two, "{{ asset_type }}: {{ raw_context }}", answer, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    assert {r.asset_id: r.failed for r in made.collect()} == {"v": False, "w": True}
    writers.save_outlines(made.filter("not failed").drop("failed"), str(tmp_path / "o"))
    found = readers.outlines(spark, str(tmp_path / "o")).first()
    assert (found.asset_id, found.title, found.heading, found.sub_points[0].heading) == ("v", "T", "h", "p")


def test_feature_files(spark, tmp_path):
    images = spark.createDataFrame([("a", "p.jpg", 0, [1.0, 2.0], "cap", [0.5])], "asset string, name string, page_idx int, bbox array<double>, text_slice string, vector array<float>")
    chunks = spark.createDataFrame([("a", 1, 2, "later", None, [0.25]), ("a", 0, 5, "first", [1.0], [0.75]), ("b", 0, 0, "alone", None, [1.0])], "asset string, page_idx int, block_idx int, text_slice string, bbox array<double>, vector array<float>")
    writers.save_document_features(images, chunks, str(tmp_path / "d"))
    shown, said = readers.document_features(spark, str(tmp_path / "d"))
    assert [(r.asset, r.name, r.page_idx, r.bbox, r.vector) for r in shown.collect()] == [("a", "p.jpg", 0, [1.0, 2.0], [0.5])]
    assert sorted((r.asset, r.page_idx, r.text_slice) for r in said.collect()) == [("a", 0, "first"), ("a", 1, "later"), ("b", 0, "alone")]
    frames = spark.createDataFrame([("v", 2.0, "time_2.00.jpg", [1.0], None, "", True), ("v", 1.0, "time_1.00.jpg", None, [0.5], "x", False)], "asset string, timestamp double, frame_name string, img_vector array<float>, text_vector array<float>, content string, need_vlm boolean")
    writers.save_video_features(frames, str(tmp_path / "v"))
    assert sorted((r.asset, r.timestamp, r.need_vlm) for r in readers.video_features(spark, str(tmp_path / "v")).collect()) == [("v", 1.0, False), ("v", 2.0, True)]


def test_a_search_that_fails(spark):
    hit = spark.createDataFrame([("x", 1.0), ("y", 0.5)], "content string, score double")

    def search(i):
        if i == 0:
            raise AnalysisException("gone", None)
        return hit.orderBy(F.desc("score"))

    seen = []
    found, states = answering.searched(search, lambda hits: seen.append(hits.count()) or "refetch")
    assert seen == [0, 2] and [(r.content, r["rank"], r.attempt) for r in found.collect()] == [("x", 0, 0), ("y", 1, 0)]
    assert states == ["Preparing", "Researching", "Evaluating", "Researching", "Evaluating", "Strengthening", "Finalizing", "Idle"]

    def broken(hits):
        raise RuntimeError

    assert answering.searched(lambda i: hit, broken)[1] == ["Preparing", "Researching", "Evaluating", "FAILED"]
    assert answering.searched(lambda i: search(0), lambda hits: "refetch")[0].count() == 0
    newest = retrieval.accumulated([hit.withColumn("rank", F.lit(0)), hit.limit(1).withColumn("rank", F.lit(0))]).collect()
    assert [r.attempt for r in newest] == [1, 0, 0]
    evidence = spark.createDataFrame([(1, "old", 0, 0), (1, "new", 1, 1), (1, "newest", 1, 0)], "conv_id int, content string, attempt int, rank int")
    history = spark.createDataFrame([(1, "h"), (2, "g")], "conv_id int, history string")
    got = answering.prompt(history, evidence, "{{ history }}: {{ evidence }}")
    assert sorted(map(tuple, got.collect())) == [(1, "h: newest new old"), (2, "g: ")]


def test_versions_and_ids(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "x string")
    for x in "abc":
        writers.replaced(df.withColumn("x", F.lit(x)), str(tmp_path / "t"))
    assert [r.x for r in writers.current(spark, str(tmp_path / "t")).collect()] == ["c"]
    first = collection.with_ids(df.union(df))
    again = collection.with_ids(df, first)
    assert again.first().id > first.agg(F.max("id")).first()[0]


def test_small_functions(spark):
    assets = spark.createDataFrame([("a.pdf", None, None, None, "/storage/a.pdf", None)], "asset_id string, asset_type string, status string, created_at string, asset_raw_path string, asset_processed_path string")
    got = registry.normalised(assets).first()
    assert (got.type, got.status, got.progress) == ("pdf", "Raw", 0) and "T" in got.created_at
    assert registry.previews(assets).first().raw_path == "//a.pdf"
    assert row(spark, F.size(sessions.conversation_prompt(F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit("q")))) == 1
    assert row(spark, text.without_any(F.lit("abc"), [])) and not row(spark, text.without_any(F.lit("abc"), ["x", "b"]))
