import numpy as np
import pytest
from evidloom.operators import knn, retrieval
from evidloom.plans import catalog
from oracle import check

DIR = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["knn_join", "question_hits", "hybrid_rerank_topk"])
def test_larger_table(spark, name):
    check(catalog.queries()[name](spark, DIR), DIR, catalog.oracle_sql()[name])


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, vector array<double>").repartition(7)


def brute(rows, asked, limit):
    out = []
    for q, x in asked:
        scored = sorted((-sum(np.array(x) * np.array(v)), i) for i, v in rows)[:limit]
        out += [(q, i, n + 1) for n, (_, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("limit", "size"), [(3, 1 << 20), (40, 1 << 20), (5, 200)])
def test_equals_brute_force(spark, limit, size, monkeypatch):
    g = np.random.default_rng(limit)
    rows = [(i, [float(x) for x in g.integers(-3, 4, 6)]) for i in range(500)]
    rows += [(1000 + i, [2.0, 1.0, 0.0, 0.0, 1.0, 1.0]) for i in range(300)]  # one vector for a third: ties by id
    asked = [(i, [float(x) for x in g.integers(-3, 4, 6)]) for i in range(25)] + [(99, [2.0, 1.0, 0.0, 0.0, 1.0, 1.0])]
    monkeypatch.setattr(knn, "TABLE", 1500)
    got = knn.nearest(frame(spark, rows, "id"), frame(spark, asked, "question_id"), limit, question_bytes=size)
    assert sorted((r.question_id, r.id, r.place) for r in got.collect()) == brute(rows, asked, limit)


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.0]), (6, [0.5, 0.0])]
    asked = [(7, [1.0, 0.0]), (8, [1.0]), (9, None), (None, [1.0, 0.0]), (10, [float("inf"), 0.0]), (11, [0.0, 1.0]), (11, [1.0, 1.0])]
    got = knn.nearest(frame(spark, rows, "id"), frame(spark, asked, "question_id"), 3)
    assert sorted(map(tuple, got.select("question_id", "id", "base").collect())) == [(7, 1, 1.0), (7, 6, 0.5), (7, 6, 0.5), (11, 1, 0.0), (11, 6, 0.0), (11, 6, 0.0)]
    assert knn.nearest(frame(spark, rows, "id").limit(0), frame(spark, asked, "question_id"), 3).collect() == []
    assert knn.nearest(frame(spark, rows, "id"), frame(spark, asked, "question_id").limit(0), 3).collect() == []


def test_scores_equal_those_of_one_question(spark):
    own = catalog._typed(spark, DIR)
    vector = catalog._question_vector(spark, DIR)
    asked = spark.createDataFrame([(5, vector)], "question_id long, vector array<double>")
    one = retrieval.base_scores(own.select("id", "vector"), vector).orderBy("base", ascending=False).limit(50)
    assert {(r.id, r.base) for r in knn.nearest(own, asked, 50).collect()} == {(r.id, r.base) for r in one.collect()}


def test_unknown_ids(spark):
    """Vectors that the details lack can't be candidates, whether they are few, many or nearly all."""
    n = 400
    v = spark.createDataFrame([(i, [1.0 - i / 1000, 0.0]) for i in range(n)], "id long, vector array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "x", "", None, None)], "question_id long, vector array<float>, q_text string, q_asset string, q_modality string, q_timestamp double")
    for known in (range(0, n, 2), range(20, n), range(n - 20, n)):
        d = spark.createDataFrame([(i, "a", "pdf", "text", 1.0, "x" if i % 3 else "y") for i in known], "id long, asset_name string, modality string, content_type string, timestamp double, content_ref string")
        one = [(r.id, r.score) for r in retrieval.hybrid_topk(v, d, [1.0, 0.0], "x", k=4).collect()]
        many = [(r.id, r.score) for r in retrieval.hybrid_many(v, d, asked, k=4).orderBy("place").collect()]
        near = sorted(known)[:20]
        want = sorted(near, key=lambda i: (-round(np.float32(1.0 - i / 1000) + (0.15 if i % 3 else 0), 4), i))[:4]
        assert [i for i, _ in one] == want and one == many


def test_vectors_are_not_shuffled(spark):
    own = catalog._typed(spark, DIR)
    plan = knn.nearest(own, catalog._questions(spark, DIR), 10)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    assert "Exchange" not in below and "vector" not in plan[: plan.index("MapInArrow")]
