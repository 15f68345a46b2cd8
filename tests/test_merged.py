import threading

import pytest
from evidloom.sources import merged

SCHEMA = "id string, status string, at long"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def table(spark, path, number=None):
    return sorted(map(tuple, merged.current(spark, path, number).collect()), key=str)


def test_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    assert merged.upsert(rows(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), (None, "n", 1)]), path, "id", ["at"]) == 1
    assert table(spark, path) == [("a", "y", 2), ("b", "x", 1), (None, "n", 1)]
    more = spark.createDataFrame([(7, "c", "z", "extra"), (9, "b", None, "extra"), (9, None, "m", "extra")], "at int, id string, status string, other string")
    assert merged.upsert(more, path, "id", ["at"]) == 2
    assert table(spark, path) == [("a", "y", 2), ("b", None, 9), ("c", "z", 7), (None, "m", 9)]
    assert table(spark, path, 1) == [("a", "y", 2), ("b", "x", 1), (None, "n", 1)]
    assert merged.upsert(rows(spark, []), path, "id", ["at"]) == 3 and len(table(spark, path)) == 4
    with pytest.raises(ValueError):
        merged.current(spark, str(tmp_path / "none"))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    merged.upsert(rows(spark, [(f"k{i}", "x", 1) for i in range(500)]), path, "id", ["at"])
    before = merged.Log(spark, path).latest()[1]["buckets"]
    merged.upsert(rows(spark, [("k7", "y", 2)]), path, "id", ["at"])
    after = merged.Log(spark, path).latest()[1]["buckets"]
    assert len(before) == merged.BUCKETS and sum(before[b] != after[b] for b in before) == 1
    assert len(table(spark, path)) == 500 and ("k7", "y", 2) in table(spark, path)


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    each = merged.upsert_each(path, "id", ["at"], "stream")
    each(rows(spark, [("a", "1", 1)]), 0)
    each(rows(spark, [("a", "2", 2)]), 1)
    merged.upsert(rows(spark, [("a", "by hand", 3)]), path, "id", ["at"])
    each(rows(spark, [("a", "2", 2)]), 1)  # sent again after a restart
    assert table(spark, path) == [("a", "by hand", 3)] and merged.Log(spark, path).numbers() == [1, 2, 3]
    merged.upsert_each(path, "id", ["at"], "other")(rows(spark, [("b", "1", 1)]), 0)
    assert len(table(spark, path)) == 2


def test_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    for i in range(3):
        rows(spark, [("a", f"s{i}", i), (f"k{i}", "x", i)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        stream.writeStream.foreachBatch(merged.upsert_each(path, "id", ["at"], "s")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert table(spark, path) == [("a", "s2", 2), ("k0", "x", 0), ("k1", "x", 1), ("k2", "x", 2)]


def test_writers_side_by_side(spark, tmp_path):
    path, wrong = str(tmp_path / "t"), []

    def write(w):
        try:
            for i in range(3):
                merged.upsert(rows(spark, [(f"w{w}-{i}", "x", i), ("shared", f"w{w}", i)]), path, "id", ["at"], f"w{w}", i, buckets=4)
        except Exception as e:
            wrong.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong and merged.Log(spark, path).numbers() == list(range(1, 10))
    found = table(spark, path)
    assert [r[0] for r in found] == ["shared", *(f"w{w}-{i}" for w in range(3) for i in range(3))]
    assert merged.Log(spark, path).latest()[1]["batches"] == {"w0": 2, "w1": 2, "w2": 2}
    gone = merged.cleaned(spark, path, 2)
    assert gone > 0 and table(spark, path) == found and merged.Log(spark, path).numbers() == [8, 9]
    assert merged.cleaned(spark, path, 2) == 0


def test_claim_is_taken_once(spark, tmp_path):
    log = merged.Log(spark, str(tmp_path / "t"))
    log.fs.mkdirs(log._path(f"{log.path}/log"))
    assert log.claim(1, {"a": 1}) and not log.claim(1, {"a": 2}) and log.read(1) == {"a": 1} and log.numbers() == [1]
