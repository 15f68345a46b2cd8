"""Variants and table functions on small rows; their queries against SQL."""

import json

import pyarrow.parquet as pq
import pytest
from evidloom.functions import tables, variants
from evidloom.plans import shapes
from pyspark.sql import functions as F

from tests.oracle import check


@pytest.mark.parametrize("query", shapes.QUERIES, ids=lambda q: q.__name__)
def test_query(spark, sf_dir, query):
    check(query(spark, sf_dir), sf_dir, shapes.ORACLE[query.__name__])


def test_both_shapes_and_others(spark, tmp_path):
    frame = {"timestamp": 1, "content": "c", "img_vector": [0.5, 2], "need_vlm": True}
    records = {"bare": [frame, frame | {"timestamp": "soon"}, 7], "under": {"alignments": [frame]}, "empty": {"alignments": []}, "other": {"x": 1}, "scalar": 3, "word": "w", "null": None}
    texts = [(k, json.dumps(v)) for k, v in records.items()] + [("broken", "{"), ("none", None), ("blank", "")]
    own = spark.createDataFrame(texts, "asset string, text string").select("asset", variants.record(F.col("text")).alias("record"))
    want = [("bare", 0, 1.0, [0.5, 2.0], None, True), ("under", 0, 1.0, [0.5, 2.0], None, True)]
    for rows in (own, None):
        if rows is None:
            variants.save_records(own, str(tmp_path / "v"))
            rows = spark.read.parquet(str(tmp_path / "v"))
        got = variants.frame_records(rows).collect()
        assert sorted((r.asset, r.place, r.timestamp, r.img_vector, r.text_vector, r.need_vlm) for r in got) == want
    assert variants.frame_records(own.limit(0)).count() == 0


def test_common_fields_are_shredded(spark, tmp_path):
    own = spark.range(1000).select(variants.record(F.concat(F.lit('{"status":"Ready","n":'), "id", F.lit("}"))).alias("record"))
    variants.save_records(own.coalesce(1), str(tmp_path / "v"))
    names = pq.ParquetFile(next((tmp_path / "v").glob("part*"))).schema.to_arrow_schema().field("record").type
    assert "typed_value" in str(names) and "status" in str(names)
    assert spark.read.parquet(str(tmp_path / "v")).filter("variant_get(record, '$.n', 'int') >= 990").count() == 10


def test_worker_result(spark):
    lines = ['log\n{"status": "ok", "n": 1}\n', "log\nno record", "[1]", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    found = rows.select("i", variants.worker_result(F.col("t")).alias("r")).select("i", "r.status", F.try_variant_get("r.data", "$.n", "int").alias("n"))
    assert sorted(map(tuple, found.collect())) == [(0, "success", 1)] + [(i, "partial_success", None) for i in range(1, 5)]


def test_table_functions(spark):
    heard = tables.hearing(lambda path: ((i, i + 0.504, f" {path}{i} ") for i in range(len(path))))
    tables.register(spark, heard_test=heard, seen_test=tables.seeing(lambda path: [(0.5, f"{path}.jpg")]))
    videos = spark.createDataFrame([("a", "xy"), ("b", ""), ("c", None)], "asset string, path string")
    rows = spark.sql("SELECT asset, h.* FROM {v}, LATERAL heard_test(path) h", v=videos).collect()
    assert sorted(map(tuple, rows)) == [("a", 0.0, 0.5, 0, "xy0"), ("a", 1.0, 1.5, 1, "xy1")]
    rows = spark.sql("SELECT asset, s.* FROM {v}, LATERAL seen_test(path) s", v=videos).collect()
    assert sorted(map(tuple, rows)) == [("a", 0.5, "xy.jpg"), ("b", 0.5, ".jpg")]


def test_answers_of_each_conversation(spark):
    turns = [(1, 2, "assistant", "a2"), (1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 3, None, "x"), (2, 0, "assistant", "alone"), (None, 0, "user", None), (None, 1, "assistant", "n")]
    tables.register(spark)
    rows = spark.sql("SELECT * FROM answers(TABLE({t}) PARTITION BY conv_id ORDER BY turn)", t=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, 0, None, None, "s"), (1, 2, 1, "q1", "a2"), (1, 3, 1, "q1", "x"), (2, 0, None, None, "alone"), (None, 1, 0, None, "n")], key=str)
