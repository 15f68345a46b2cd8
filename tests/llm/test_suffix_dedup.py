import hashlib
import random

import numpy as np
from evidloom.llm.common import table
from evidloom.llm.suffix_dedup import ORACLE, remove_repeats
from evidloom.llm.suffix_order import deep_shallow_order, padded
from oracle import check


def brute(rows, length):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def test_order_equals_plain_sort():
    rng = random.Random(3)
    data = b"".join(rng.choice([b"a" * 60, b"ab" * 40, bytes(rng.randrange(256) for _ in range(70)), b"the same passage again and again, over and over. "]) for _ in range(60))
    buf, length = padded(data, 50), 50
    pos = np.arange(len(data) - length + 1)
    order, head = deep_shallow_order(buf, pos, length)
    cut = [data[p : p + length] for p in pos[order].tolist()]
    assert cut == sorted(cut)
    assert head.tolist() == [i == 0 or cut[i] != cut[i - 1] for i in range(len(cut))]


def test_small_texts(spark):
    rng = random.Random(5)
    words = ["alpha", "béta", "gamma", "δelta", "epsilon", "zeta"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = [(3, passage), (1, "start " + passage[:150] + " end"), (2, None), (4, ""), (5, "a" * 300), (7, "a" * 50), (6, "b" + "a" * 49), (8, passage + passage), (9, "x" * 49), (10, " ".join(rng.choice(words) for _ in range(9000)) + passage[30:90])]
    rows += [(100 + i, passage[i : i + 80]) for i in range(30)]
    df = spark.createDataFrame([(d, t, "x", t) for d, t in rows], "doc_id long, text string, block string, hashes string")
    got = sorted(tuple(r) for r in remove_repeats(df, block_bytes=500).collect())
    assert got == brute(rows, 50)


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert remove_repeats(spark.createDataFrame([], schema)).collect() == []
    t = "one two three four five six seven eight nine ten eleven twelve"
    got = sorted((tuple(r)[:4] for r in remove_repeats(spark.createDataFrame([(None, t), (4, t), (4, t)], schema)).collect()), key=str)
    n = len(t)
    assert got == [(4, n, 0, 0), (4, n, 0, 0), (None, n, n, 1)]


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in remove_repeats(docs, block_bytes=1 << 16).collect()) == brute(rows, 50)


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    check(remove_repeats(table(spark, d, "documents")), d, ORACLE)
