import glob
import random

import pyarrow.parquet as pq
from evidloom.operators import retrieval
from evidloom.sources import writers
from pyspark.sql import functions as F


def scanned(df):
    """Rows that the scan gave on, from the metrics of the executed plan."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return rows, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_few_ids_read_few_groups(spark, tmp_path):
    """Of 60,000 texts in 4 files, 40 ids read under a fifth; from a table as it comes, nearly all."""
    n, plain, path = 60_000, str(tmp_path / "plain"), str(tmp_path / "by_id")
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("content_ref")).repartition(8)
    rows.write.parquet(plain)
    assert writers.save_by_id(rows, path, file_rows=15_000, group_bytes=64 << 10) == n
    files = glob.glob(f"{path}/*.parquet")
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in files]
    assert len(files) == 4 and min(groups) > 20
    r = random.Random(1)
    close = list(range(31_000, 31_020)) + [r.randrange(n) for _ in range(20)]
    wanted = lambda p: spark.read.parquet(p).filter(F.col("id").isin(close))
    found, read = scanned(wanted(path))
    assert sorted(x.id for x in found) == sorted(set(close)) and read < n / 5
    assert scanned(wanted(plain))[1] > n / 2
    absent = spark.read.parquet(path).filter(F.col("id").isin([n + 5, -3]))
    assert scanned(absent) == ([], 0)


def test_hits_from_the_layout(spark, tmp_path):
    v = spark.createDataFrame([(i, [1.0 - i / 1000, 0.0]) for i in range(500)], "id long, vector array<float>")
    d = spark.createDataFrame([(i, "a", "pdf", "text", 1.0, f"text {i}") for i in range(500)], "id long, asset_name string, modality string, content_type string, timestamp double, content_ref string")
    writers.save_by_id(d, str(tmp_path / "t"))
    got = retrieval.hybrid_topk(v, spark.read.parquet(str(tmp_path / "t")), [1.0, 0.0], "text 3", k=4).collect()
    assert [x.id for x in got] == [x.id for x in retrieval.hybrid_topk(v, d, [1.0, 0.0], "text 3", k=4).collect()]
    assert writers.save_by_id(d.limit(0), str(tmp_path / "none")) == 0 and spark.read.parquet(str(tmp_path / "none")).count() == 0
