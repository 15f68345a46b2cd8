import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from evidloom.llm import catalog, quality_rules
from evidloom.llm.common import table
from pyspark.sql import functions as F

from oracle import check


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equals_sql(spark, sf):
    d = f"/root/testdata/sf{sf}"
    check(catalog.op2_quality_rules(spark, d), d, quality_rules.ORACLE)


def test_base_counts(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x x x", "l1\nl1\n \n\nl1 \nl1", "é# ü% $$ <b>|", "a\x0bb\x0cc\rd\x1ce f", *(" ".join(rng.choice("abcde") for _ in range(rng.randrange(3, 60))) for _ in range(60)), "w " * 30_000]
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, stratum string")
    for r in quality_rules.measured(docs).collect():
        t = texts[r.doc_id] or ""
        w = [x for x in t.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if x]
        tri = Counter(zip(w, w[1:], w[2:]))
        cov = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(cov))


def test_binomial_tail(spark):
    cases = [(0, 500), (3, 900), (11, 4000), (150, 20_000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert math.isclose(math.exp(r.p), want, rel_tol=1e-8)


def made(i, extra=""):
    return " ".join(f"w{(i * 37 + j * 11) % 997}" for j in range(60)) + extra


JUNK = " " + " ".join(f"#%${j}" for j in range(60))


def test_rules_need_evidence(spark):
    rows = [(i, made(i), "en") for i in range(60)] + [(900 + i, made(i, JUNK), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 900)) for i, _, _ in rows], "doc_id long, quality int")
    few = quality_rules.apply_rules(docs, labels)
    assert few.filter(~F.col("base_failed") & ~F.col("kept")).count() == 0
    loose = quality_rules.apply_rules(docs, labels, alpha=0.5, delta=0.5)
    assert {r.doc_id for r in loose.filter(~F.col("base_failed") & ~F.col("kept")).collect()} == set(range(900, 920))
    assert quality_rules.apply_rules(docs.limit(0), labels.limit(0)).collect() == []
    assert quality_rules.apply_rules(docs, labels.limit(0)).count() == len(rows)


def test_rejects_junk_and_spares_good(spark):
    rows = [(i, made(i), "en") for i in range(500)] + [(1000 + i, made(i, JUNK), "en") for i in range(40)]
    rows += [(2000 + i, made(i), "de") for i in range(20)] + [(3000 + i, made(i, JUNK), "de") for i in range(12)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, y int")
    marks = [(i, int(i < 1000 or 2000 <= i < 3000)) for i, _, _ in rows if i != 499]
    # Odd labels: null ones and null ids teach nothing, one 0 makes a text bad, an id without a document is none.
    labels = spark.createDataFrame([*marks, (3, 0), (4, None), (None, 0), (77777, 1)], "doc_id long, quality int")
    got = quality_rules.apply_rules(docs, labels)
    # About 370 good labels of the holdout certify at 0.05 / 2 strata, 15 don't.
    assert {r.doc_id for r in got.filter(~F.col("base_failed") & ~F.col("kept")).collect()} == set(range(1000, 1040))


def test_false_rejection_is_limited(spark):
    """Many strata whose true rejection rates are known: those that lose more than ``alpha`` are about the level's share at most."""
    rng, strata, alpha, level = np.random.default_rng(3), 240, 0.05, 0.05
    frames = []
    for s in range(strata):
        n, tail = 400, rng.uniform(0.005, 0.06, len(quality_rules.MEASURES))
        good = np.where(rng.random((n, 5)) < tail, 800, 0)
        bad = np.where(rng.random((60, 5)) < 0.3, 800, 0)
        frames.append(pd.DataFrame(np.concatenate([good, bad]), columns=quality_rules.MEASURES).assign(stratum=str(s), y=[1] * n + [0] * 60, proposes=rng.random(n + 60) < 0.25, **{f"true_{m}": t for m, t in zip(quality_rules.MEASURES, tail)}))
    data = pd.concat(frames)
    true = {s: [g[f"true_{m}"].iloc[0] for m in quality_rules.MEASURES] for s, g in data.groupby("stratum")}
    rules = quality_rules.cutoffs(spark.createDataFrame(data[["stratum", "y", "proposes", *quality_rules.MEASURES]]), alpha, level * strata).collect()
    risk = [1 - math.prod(1 - t for t, m in zip(true[r.stratum], quality_rules.MEASURES) if r[f"{m}_cutoff"] is not None) for r in rules]
    assert sum(x > 0 for x in risk) > 20  # rules are certified
    assert sum(x > alpha for x in risk) <= strata * level + 3 * (strata * level) ** 0.5


def test_effect_on_the_table(spark):
    """On the larger table rules are certified, equal the SQL's, and reject bad texts and hardly a good one."""
    d = "/root/testdata/sf0.1"
    got = catalog.op2_quality_rules(spark, d)
    check(got, d, quality_rules.ORACLE)
    judged = got.filter("not base_failed").join(table(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    of = {r.quality: r.kept / r.n for r in judged.collect()}
    assert of[1] >= 0.98 and of[0] <= 0.2
