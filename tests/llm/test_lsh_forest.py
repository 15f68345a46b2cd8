import random

import numpy as np
import pytest
from evidloom.llm import catalog, lsh_forest
from evidloom.llm.shingles import shingle_sets
from oracle import check
from test_jaccard_join import brute, chains, shingles


def wanted(docs):
    return sorted(((d, n, c, d == c) for d, n, c in brute(docs, 85)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_contract(spark, sf):
    check(catalog.op11_near_dedup(spark, f"/root/testdata/sf{sf}"), f"/root/testdata/sf{sf}", lsh_forest.ORACLE)


def star(rng, n):
    """Copies of one text with changes of their own: near to the text, not near to each other."""
    base = [f"w{rng.randrange(9999)}" for _ in range(70)]
    docs = [base]
    for _ in range(n):
        w = list(base)
        w[rng.randrange(5, 65)] = f"own{rng.randrange(10**9)}"
        docs.append(w)
    return docs


@pytest.mark.parametrize("dense", [4, 64])
def test_chains_and_stars(spark, dense, monkeypatch):
    rng = random.Random(5)
    docs = chains(rng, 40)
    docs += [(1000 + i, " ".join(w)) for i, w in enumerate(star(rng, 150))]
    docs += [(2000 + i, docs[i][1].upper()) for i in range(0, 200, 7)]
    rng.shuffle(docs)
    monkeypatch.setattr(lsh_forest, "DENSE", dense)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(lsh_forest.near_duplicates(df)) == wanted(docs)


def test_edges(spark):
    long = " ".join(f"v{i * i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two three"), (7, "one two three "), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (8, "x y z u v w " * 400), (8, "x y z u v w " * 400), (9, "q r s t u v w x y z"), (9, "completely other words are in this text"), (10, "q r s t u v w x y z"), (None, None), (11, long), (12, long + " more"), (13, "y" * 1_000_000), (14, "\xc4b c d e f"), (15, "\xe4b c d e f")]
    docs += [(8, "x y z u v w " * 400)] * 30  # one row for more than half of the table
    df = spark.createDataFrame([(*x, 1, "k") for x in docs], "doc_id long, text string, sig int, vid string")
    assert got(lsh_forest.near_duplicates(df)) == wanted(docs)
    assert got(lsh_forest.near_duplicates(df.limit(0))) == []
    assert lsh_forest.near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    with pytest.raises(ValueError):
        lsh_forest.near_duplicates(df, percent=70)


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    for changes in (5, 20, 60):
        w = list(base)
        for i in rng.sample(range(500), changes):
            w[i] = f"x{rng.random()}"
        texts = [" ".join(base), " ".join(w)]
        a, b = (shingles(t) for t in texts)
        x, y = (np.frombuffer(m, ">u2") for m in lsh_forest.minima(shingle_sets([t.encode() for t in texts])))
        assert abs((x == y).mean() - len(a & b) / len(a | b)) < 0.17


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n, d in ((1, 1), (50, 9), (3000, 400)):
        a = np.unique(rng.integers(0, 1 << 63, n + d, np.uint64))
        b = a[d:]
        x, y = lsh_forest.parities(a), lsh_forest.parities(b)
        assert len(x) == lsh_forest.PARITIES // 64 and sum(bin(int(i ^ j) & (1 << 64) - 1).count("1") for i, j in zip(x, y)) <= d


def test_larger_table(spark):
    """All of sf0.1 against the exact join of another method at 85 percent."""
    from evidloom.llm import jaccard_join
    from evidloom.llm.common import table

    docs = table(spark, "/root/testdata/sf0.1", "documents")
    want = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, percent=85).collect())
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(docs).collect()) == want
