import hashlib
import random
import re
import time

import pytest
from evidloom.llm import catalog
from evidloom.llm.byte_automaton import Combined, backward
from evidloom.llm.common import table
from evidloom.llm.secrets import ADDED, BASE, ORACLE, Scanner, digest, scan
from oracle import check

CONTRACT = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(CONTRACT) for m in p.finditer(text or "") if ok(m)]
    base = ",".join(f"{CONTRACT[k][0]}:{a}:{b}" for a, k, b in sorted(found))
    added = [(m.start(), len(BASE) + k, m.end()) for k, r in enumerate(ADDED) for m in re.finditer(r.pattern, text or "") if re.fullmatch(r.kept, m[0])]
    names = [r.kind for r in BASE + ADDED]
    spans = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found + added))
    n = [sum(k == i for _, i, _ in found) for k in range(3)]
    return (*n, hashlib.sha256(base.encode()).hexdigest(), spans)


ODD = [
    None, "", "a" * 16, "a" * 15, "token: password: hunter2hunter2", "token = 'abcdefghijkl'", "token==abcdefghijkl", "secrettoken=abcdefghijklmnop", "API_KEY:\"x.y/z+w=1234567", "apikey  =  \"" + "z" * 11,
    "AKIAAKIA" + "Q" * 12, "XAKIA" + "0" * 14, "AKIA" + "0" * 13, "é token=ééé token=" + "a1" * 8, "日本 " + "0f" * 9 + " 語", "ghp_" + "Ab1" * 8, "eyJhbGci.eyJzdWIi.c2lnbmF0", "-----BEGIN RSA PRIVATE KEY-----\nabc", "token=secret=passwd:" + "k" * 30,
    "x" * 100_000 + " secret: " + "Q" * 40, "xoxb-1234567890-abc", "token = " * 50 + "abcdefabcdefabcdef", "AIza" + "b" * 30,
]


def rows():
    rng = random.Random(2)
    bits = ["token", "secret", "=", ":", " ", "  ", "'", '"', "api_key", "apikey", "PassWord", "AKIA", "AKI", "abc123", "0123456789abcdef", "Z9", "\n", ",", "é", ".", "ghp_", "eyJab"]
    return [*enumerate(ODD), *((1000 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(1500))]


def test_equals_patterns(spark):
    want = sorted((d, *brute(t)) for d, t in rows())
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows()], "doc_id long, text string, kind string, start int")
    assert sorted(tuple(r) for r in digest(scan(df)).collect()) == want


def test_whole_table(spark, sf_dir):
    want = sorted((r.doc_id, *brute(r.text)) for r in table(spark, sf_dir, "documents").collect())
    assert sorted(tuple(r) for r in catalog.op4_secret_scan(spark, sf_dir).collect()) == want


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=abcdefghijklmnop z"), (2, None), (3, "clean"), (3, "clean")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in scan(df, redact=True).collect()) == [(1, "a [assign] z"), (2, None), (3, "clean"), (3, "clean")]
    assert scan(df.limit(0)).collect() == []


def test_equals_sql(spark, sf_dir):
    check(catalog.op4_secret_scan(spark, sf_dir), sf_dir, ORACLE)


def test_minimal_and_bounded():
    assert len(backward(b"ab|cb")[0]) == len(backward(b"(a|c)b")[0]) == 4
    for refused in (rb"(a)\1", b"a(bc)?", b"ab|abce", b"abcd|bc"):  # not regular; matches that stop being one while they grow; one sure while an earlier is open
        with pytest.raises(ValueError):
            Combined([(refused, refused)])
    assert Scanner().any.states < 20_000


@pytest.mark.parametrize("bit", ["eyJ", "eyJ.", "AKIA", "token", "token =", "a", "ghp_", "eyJa.eyJb.c "])
def test_linear_time(bit):
    scanner = Scanner().tables()
    text = bit * (1_000_000 // len(bit)) + "."
    began = time.time()
    scanner.spans(text)
    assert time.time() - began < 10
