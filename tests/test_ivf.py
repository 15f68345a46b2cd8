import numpy as np
from evidloom.operators import ivf
from evidloom.operators.retrieval import base_scores
from evidloom.plans.catalog import table
from pyspark.sql import functions as F


def test_index(spark, tmp_path):
    v = table(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    query = list(v.filter("id = 3").first().vector)
    centroids, rows = ivf.indexed(v, cells=16)
    ivf.saved(rows, str(tmp_path / "index"))
    stored = ivf.loaded(spark, str(tmp_path / "index"))
    exact = [(r.id, r.base) for r in base_scores(v, query).orderBy(F.desc("base"), "id").limit(10).collect()]
    assert [(r.id, r.base) for r in ivf.ivf_topk(stored, centroids, query, 10, probes=16).collect()] == exact
    some = ivf.ivf_topk(stored, centroids, query, 10, probes=4)
    assert all(r.base <= e[1] for r, e in zip(some.collect(), exact)) and some.first().id == 3
    assert "cell" in stored.filter(F.col("cell") == 1)._jdf.queryExecution().executedPlan().toString()
    assert ivf.ivf_topk(ivf.indexed(v.limit(0))[1], ivf.Centroids(()), query, 5).collect() == []


def test_recall(spark):
    """Of the ten best, over all queries with an id divisible by 50, with the cells and probes that are the default."""
    v = table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    centroids, rows = ivf.indexed(v)
    rows = rows.select("id", "cell", "vector").collect()
    ids, cells, x = np.array([r.id for r in rows]), np.array([r.cell for r in rows]), np.array([r.vector for r in rows], float)
    found = []
    for q in x[ids % 50 == 0]:
        best = np.argsort(-(x @ q), kind="stable")[:10]
        found.append(np.isin(cells[best], centroids.nearest(q.tolist(), ivf.PROBES)).mean())
    assert len(found) == 40 and np.mean(found) >= 0.9


def exact(x, ids, q, k=10):
    return set(ids[np.lexsort((ids, -(x @ q)))[:k]].tolist())


def test_codes_on_vectors_without_clusters(spark):
    """All codes are read, a tenth of the vectors is scored; recall over all queries with an id divisible by 50."""
    v = table(spark, "/root/testdata/sf0.1", "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    codes, rows = ivf.coded(v)
    rows = rows.select("id", "cell", "code", "vector").collect()
    ids, cells, x = np.array([r.id for r in rows]), np.array([r.cell for r in rows]), np.array([r.vector for r in rows], float)
    code = np.array([np.frombuffer(r.code, np.uint8) for r in rows])
    found = []
    for q in x[ids % 50 == 0]:
        near = np.argsort(-codes.scores(q, code, cells), kind="stable")[:200]
        found.append(len(exact(x, ids, q) & set(ids[near].tolist())) / 10)
    assert len(ids) == 2000 and len(found) == 40 and np.mean(found) >= 0.97


def test_codes_on_clusters(spark, tmp_path):
    """Under a fifth of the vectors is in the probed cells, and recall is at least 0.9; scores are exact."""
    g = np.random.default_rng(8)
    middle = g.normal(size=(60, 16))
    x = np.concatenate([m + 0.15 * g.normal(size=(50, 16)) for m in middle])
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(6)
    codes, rows = ivf.coded(v, cells=64)
    ivf.saved(rows, str(tmp_path / "index"))
    stored = ivf.loaded(spark, str(tmp_path / "index"))
    ids, share, found = np.arange(len(x)), [], []
    sizes = dict(stored.groupBy("cell").count().collect())
    for i in range(0, len(x), 300):
        got = ivf.coded_topk(stored, codes, x[i].tolist(), 10, probes=8, rescored=60).collect()
        assert [round(r.base, 9) for r in got] == sorted((round(float(x[r.id] @ x[i]), 9) for r in got), reverse=True)
        found.append(len(exact(x, ids, x[i]) & {r.id for r in got}) / 10)
        share.append(sum(sizes.get(c, 0) for c in ivf.Centroids(tuple(map(tuple, codes.cells))).nearest(x[i].tolist(), 8)) / len(x))
    assert np.mean(found) >= 0.9 and max(share) < 0.2, (found, share)


def test_codes_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 1.0, 0.0, 0.0])], "id long, vector array<double>")
    codes, rows = ivf.coded(v, cells=2)
    assert [r.id for r in ivf.coded_topk(rows, codes, [1.0, 0.0, 0.0, 0.0], 2).collect()] == [1, 2]
    codes, rows = ivf.coded(v.limit(0))
    assert codes is None and ivf.coded_topk(rows, codes, [1.0, 0.0, 0.0, 0.0], 2).collect() == []


def test_exact_search_finds_what_codes_rank_low(spark):
    """Among vectors without clusters, few rows that codes choose miss some of the best; an exact search doesn't."""
    g = np.random.default_rng(5)
    x = g.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(4)
    codes, rows = ivf.coded(v, cells=4)
    rows, ids, missed = rows.cache(), np.arange(len(x)), 0
    for i in range(0, 200, 50):
        some, got = ([r.id for r in ivf.coded_topk(rows, codes, x[i].tolist(), 10, rescored=12, exact=e).collect()] for e in (False, True))
        assert got == ids[np.lexsort((ids, -(x @ x[i])))[:10]].tolist()
        missed += some != got
    assert missed
    assert [r.id for r in ivf.coded_topk(rows, codes, x[0].tolist(), 10, rescored=3, exact=True).collect()] == ids[np.lexsort((ids, -(x @ x[0])))[:10]].tolist()
    rows.unpersist()
