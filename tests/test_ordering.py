import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.ordering import group_cutoffs, hash_bucket, numbered, running_total
from millrace.session import durable, release, shared_dir


def test_hash_bucket_is_monotone(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("h")).withColumn("b", hash_bucket(F.col("h"), 64)).orderBy("h").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and {r.b for r in rows} == set(range(64))
    with pytest.raises(ValueError):
        hash_bucket(F.col("h"), 48)


def test_running_total(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), k, r.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int").withColumn("bucket", F.floor(F.col("k") / 37))
    got = {(x.g, x.k): x.t for x in running_total(df, ["g"], "bucket", [F.col("k")], "v", "t").collect()}
    total = {"a": 0, "b": 0}
    for g, k, v in rows:
        total[g] += v
        assert got[g, k] == total[g]


@pytest.mark.parametrize("buckets", [4, 256])
def test_group_cutoffs(spark, buckets):
    r = random.Random(2)
    rows = [(r.choice("aaab"), r.choice([r.random(), 0.5, 0.25])) for _ in range(900)] + [("c", 0.1)]
    df = spark.createDataFrame(rows, "g string, s double")
    got = {x.g: x for x in group_cutoffs(df, "g", "s", F.expr("n_rows div 3"), buckets).collect()}
    for g in "ab":
        v = sorted((s for k, s in rows if k == g), reverse=True)
        k = len(v) // 3
        assert got[g].cutoff == v[k - 1] and got[g].n_kept == sum(s >= v[k - 1] for s in v) and got[g].n_rows == len(v)
    assert "c" not in got


def test_numbered(spark):
    df = spark.createDataFrame([("a", 5), ("a", -3), ("b", 7), ("a", 900)], "g string, k long")
    assert {(r.g, r.k): r.n for r in numbered(df, ["g"], "k", "n").collect()} == {("a", -3): 0, ("a", 5): 1, ("a", 900): 2, ("b", 7): 0}
    assert [r.n for r in numbered(spark.range(100).toDF("k"), [], "k", "n").orderBy("k").collect()] == list(range(100))
    assert numbered(df.limit(0), [], "k", "n").count() == 0


def test_durable_cuts_lineage(spark):
    df = durable(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect() and "parquet" in df._jdf.queryExecution().toString().lower()
    assert shared_dir(spark)
    assert release(spark) >= 1 and release(spark) == 0
