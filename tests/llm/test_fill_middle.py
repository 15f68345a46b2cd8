import hashlib
import re

import pytest
from evidloom.llm import catalog, fill_middle
from oracle import check
from pyspark.sql import functions as F


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_contract(spark, sf):
    check(catalog.op12_fill_middle(spark, f"/root/testdata/sf{sf}"), f"/root/testdata/sf{sf}", fill_middle.ORACLE)


def brute(doc_id, text, grammar=r"[^\n]*\n|[^\n]+", rate=100):
    text = text or ""
    units = re.findall(grammar, text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", text, None, None
    spm = h4 % 100 < 50
    return n, "spm" if spm else "psm", f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


TEXTS = ["", None, "\n", "\n\n", "one", "one\n", "\none", "a\r\nb\r\n", "a <P> b\nc", "<\n<S\n<\nM>\n", "\U0001f926‍♂️ x\n\U0001f1e9 y\n", " \n ", "same\nsame\n", "same\nsame\n", "\x00\n\x85 \n", "no end" * 9]


def test_edges(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS * 3)] + [(None, "a\nb\nc\n", "k"), (5, "x\n" * 300_000 + "tail", "k"), (5, "x\n" * 300_000 + "tail", "k"), (6, "y" * 1_000_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _t string").repartition(5)
    got = fill_middle.rearranged(df)
    assert got.columns == ["doc_id", "text", "_t", "fim"]
    found = got.withColumn("back", fill_middle.restored(F.col("fim.form"), F.col("fim.output"))).collect()
    assert sorted(((r.doc_id, r.text, *r.fim) for r in found), key=str) == sorted(((i, t, *brute(i, t)) for i, t, _ in rows), key=str)
    assert all(r.back == (r.text or "") for r in found)
    assert {r.fim.form for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.digest(fill_middle.rearranged(df.limit(0))).collect() == []


@pytest.mark.parametrize(
    ("grammar", "pattern"),
    [(fill_middle.LINES, r"[^\n]*\n|[^\n]+"), (fill_middle.WORDS, r"[^ \t\n]*[ \t\n]+|[^ \t\n]+"), (fill_middle.RUNS, r"[ \t\n]+|[^ \t\n]+"), (fill_middle.CHARACTERS, r"[\s\S]")],
)
def test_grammars(spark, grammar, pattern):
    texts = ["", "a b  c\n d", "  lead", "trail  ", "\U0001f926‍♂️é\U0001f1e9", "x", "\n\n", "äö ü\tß"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = dict(df.select("doc_id", fill_middle.units(F.col("text"), grammar)).collect())
    assert [got[i] for i in range(len(texts))] == [re.findall(pattern, t) for t in texts]


def test_rate_and_null(spark):
    df = spark.createDataFrame([(i, f"l{i}\nm\nn\no") for i in range(300)], "doc_id long, text string")
    got = fill_middle.rearranged(df, rate=40, spm_share=0).select("doc_id", "text", "fim.*").collect()
    assert [tuple(r)[2:] for r in sorted(got)] == [brute(r.doc_id, r.text, rate=40) if brute(r.doc_id, r.text, rate=40)[1] == "plain" else (r.n, "psm", r.output, r.prefix_chars, r.middle_chars) for r in sorted(got)]
    assert 80 < sum(r.form == "psm" for r in got) < 160
    assert spark.range(1).select(fill_middle.units(F.lit(None).cast("string")).alias("u"), fill_middle.restored(F.lit("psm"), F.lit(None).cast("string")).alias("r")).first() == (None, None)


def test_native(spark):
    plan = catalog.op12_fill_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not re.search("Python|Arrow|Pandas", plan)
