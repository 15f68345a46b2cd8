"""Readers, writers and the stream, on small files."""

import json

from evidloom.plans import copies, shapes
from evidloom.sources import folders, readers, writers
from evidloom.streaming import assets
from pyspark.sql import functions as F


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def test_registry_and_sessions(spark, tmp_path):
    record = {"asset_id": "a.pdf", "asset_type": "pdf", "status": "Ready"}
    put(tmp_path / "r/one.json", {"a.pdf": record})
    put(tmp_path / "r/two.json", {"assets_map": {"b.mp4": {"asset_type": "video"}}})
    rows = {r.asset_id: (r.status, r.retry_count) for r in readers.registry(spark, str(tmp_path / "r")).collect()}
    assert rows == {"a.pdf": ("Ready", 0), "b.mp4": ("Raw", 0)}
    put(tmp_path / "s/c1.json", {"chat_id": "c1", "status": "Idle", "messages": [{"role": "user", "message": "hi", "timestamp": "t"}]})
    put(tmp_path / "s/bad.json", "{not json")
    found = readers.sessions(spark, str(tmp_path / "s"))
    assert [r.chat_id for r in found.collect()] == ["c1"]
    assert [(r.turn, r.message) for r in readers.session_messages(found).collect()] == [(0, "hi")]
    writers.save_sessions(found, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("part=*")] == ["part=c1"]


def test_media(spark, tmp_path):
    put(tmp_path / "auto/d.json", {"pdf_info": [{"preproc_blocks": [{"type": "text", "text": "from auto"}]}]})
    put(tmp_path / "ocr/d.json", {"pdf_info": [{"preproc_blocks": [{"type": "text", "text": "from ocr"}]}]})
    put(tmp_path / "ocr/e.json", {"pdf_intermediate_dict": []})
    docs = readers.parsed_documents(spark, [str(tmp_path / "auto"), str(tmp_path / "ocr")])
    assert {r.asset: bool(r.pdf_info) for r in docs.collect()} == {"d": True, "e": False}
    assert docs.filter("asset = 'd'").first().pdf_info[0].preproc_blocks[0].text == "from auto"
    put(tmp_path / "t/v.json", {"asset_id": "v", "language": "en", "duration": 3.0, "segments": [{"start": 0.0, "end": 1.256, "text": " a "}]})
    segments = readers.transcripts(spark, str(tmp_path / "t"))
    assert [(r.asset, r.end) for r in segments.collect()] == [("v", 1.256)]
    writers.save_transcripts(segments.withColumns({"language": F.lit("en"), "duration": F.lit(3.0)}), str(tmp_path / "tout"))
    assert [(r.end, r.text) for r in readers.transcripts(spark, str(tmp_path / "tout")).collect()] == [(1.26, "a")]
    for name in ("v/time_1.50.jpg", "v/time_x.jpg", "v/cover.jpg"):
        put(tmp_path / "f" / name, "x")
    assert [(r.asset, r.ts) for r in readers.frames(spark, str(tmp_path / "f")).collect()] == [("v", 1.5)]
    for name in ("a.pdf", "b.MP4", "c.avi"):
        put(tmp_path / "u" / name, "x")
    assert {r.asset_id: r.asset_type for r in readers.uploads(spark, str(tmp_path / "u")).collect()} == {"a.pdf": "pdf", "b.MP4": "video"}


def test_features(spark, tmp_path):
    image = {"type": "image", "page_idx": 0, "text_slice": "c", "embedding": [1.0], "bbox": [1.0]}
    put(tmp_path / "d/a/clip_features.json", {"images": {"x.jpg": image}, "text_chunks": [image | {"type": "text"}]})
    pictures, chunks = readers.document_features(spark, str(tmp_path / "d"))
    assert [(r.asset, r.name) for r in pictures.collect()] == [("a", "x.jpg")] and chunks.count() == 1
    frame = {"timestamp": 1.0, "frame_name": "f", "img_vector": [1.0], "text_vector": None, "content": "c", "need_vlm": True}
    put(tmp_path / "v/b/clip_features.json", [frame])
    put(tmp_path / "v/c/clip_features.json", {"alignments": [frame, frame]})
    assert sorted(r.asset for r in readers.video_features(spark, str(tmp_path / "v")).collect()) == ["b", "c", "c"]
    put(tmp_path / "o/a.json", {"asset_id": "a", "generated_at": "t", "outline": {"title": "T", "outline": [{"heading": "h", "anchor": 1.0, "summary": "s", "sub_points": []}]}})
    assert [(r.title, r.heading) for r in readers.outlines(spark, str(tmp_path / "o")).collect()] == [("T", "h")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    writers.replaced(df, str(tmp_path / "t"))
    writers.replaced(df.withColumn("x", F.lit("b")), str(tmp_path / "t"))
    assert [r.x for r in writers.current(spark, str(tmp_path / "t")).collect()] == ["b"]
    rows = spark.createDataFrame([(1, "pdf"), (2, "video")], "id long, modality string")
    assert writers.append_collection(rows, str(tmp_path / "c")) == 2 and writers.append_collection(rows, str(tmp_path / "c")) == 2
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4  # ingesting again makes new rows
    files = spark.createDataFrame([("a", "x.jpg", 5), ("a", "y.jpg", 0)], "asset string, name string, length long")
    assert sorted((r.name, r.url) for r in writers.uploaded(files, "http://store").collect()) == [("x.jpg", "http://store/a/x.jpg"), ("y.jpg", None)]


def test_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"a{i}", "Raw")], "asset_id string, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    done = []

    def each(batch, number):
        done.extend((number, r.asset_id, r.status) for r in assets.advanced(batch, {}).collect())

    for _ in range(2):  # a restart does nothing twice
        assets.ingest(spark, str(tmp_path / "in"), "asset_id string, status string", each, str(tmp_path / "check")).awaitTermination()
    assert sorted(x[1:] for x in done) == [("a0", "Ready"), ("a1", "Ready"), ("a2", "Ready")] and len({x[0] for x in done}) == 3
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 05:00:00", "x"), ("2024-01-02 01:00:00", "y")], "ts string, event_type string")
    assert sorted(r.n for r in assets.windowed_counts(events).collect()) == [1, 2]


def test_many_sessions_in_a_file(spark, tmp_path, monkeypatch):
    """Sessions of a table are lines of few files, whatever their texts hold, and both queries read them all back."""
    texts = ["a\nb\r\nc", "x y\u0085z", "\x0b\x0c\x1c", '"{', "", None]
    rows = [(f"c{i}", "Idle", [("user", texts[i % 6], None)]) for i in range(600)]
    found = spark.createDataFrame(rows, "chat_id string, status string, messages array<struct<role:string,message:string,timestamp:string>>")
    writers.save_session_lines(found.coalesce(2), str(tmp_path / "few"))
    assert len(list((tmp_path / "few").rglob("*.json"))) == 2
    folders.register(spark)
    for back in (readers.session_lines(spark, str(tmp_path / "few")), spark.read.format("evidence_sessions").load(str(tmp_path / "few")).filter("fault is null")):
        assert sorted((r.chat_id, r.messages[0].message) for r in back.collect()) == sorted((c, m[0][1]) for c, _, m in rows)
    conversations = spark.range(900).selectExpr("id div 3 as conv_id", "cast(id % 3 as int) as turn", "'user' as role", "concat('t', id) as text")
    conversations.coalesce(1).write.parquet(str(tmp_path / "in/conversations.parquet"))
    for query in (copies.session_copy, shapes.session_scan):
        monkeypatch.setattr(copies, "_folder", lambda spark: str(tmp_path / query.__name__))
        found = query(spark, str(tmp_path / "in")).collect()
        assert len(found) == 300 and {r.n for r in found} == {3} and sum(r.status == "FAILED" for r in found) == 43
        assert len(list((tmp_path / query.__name__).rglob("*.json"))) < 30
