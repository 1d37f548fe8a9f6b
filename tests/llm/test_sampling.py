from collections import Counter

from millrace.llm.sampling import categorised, draw, expected_shortfall, stratified_sample

TRIPLE = "triple_id long, question_type string, difficulty string, u string, accept string"
TARGET = "question_type string, difficulty string, target_permille int, min_keep int"


def build(spark, sizes):
    rows, k = [], 0
    for (t, d), n in sizes.items():
        for _ in range(n):
            rows.append((k, t, d, "clash", "clash"))
            k += 1
    return spark.createDataFrame(rows, TRIPLE)


def test_exact_counts_and_report(spark):
    df = build(spark, {("factual", "simple"): 700, (" Factual ", "SIMPLE"): 100, ("how", "hard"): 30, (None, " "): 20, ("spare", "easy"): 150})
    targets = spark.createDataFrame([("factual", "simple", 600, 1), ("how", "hard", 300, 2), ("unknown", "unknown", 50, 15), ("none", "none", 50, 4)], TARGET)
    sample, report = stratified_sample(df.unionByName(df.limit(50)), targets)
    got = Counter((r.question_type, r.difficulty) for r in sample.collect())
    assert got == {("factual", "simple"): 120, ("how", "hard"): 30, ("unknown", "unknown"): 15}
    assert sample.select("triple_id").distinct().count() == sum(got.values())
    lacking = {(r.question_type, r.deficit) for r in report.collect() if r.deficit}
    assert lacking == {("how", 30), ("none", 10)}


def test_draw_is_the_smallest_hashes_and_repeats(spark):
    df = build(spark, {("a", "b"): 500})
    targets = spark.createDataFrame([("a", "b", 1000, 0)], TARGET)
    first, second = (sorted(r.triple_id for r in stratified_sample(df, targets)[0].collect()) for _ in range(2))
    assert first == second and len(first) == 100
    order = sorted((r.u, r.triple_id) for r in categorised(df).collect())
    assert first == sorted(i for _, i in order[:100])


def test_shortfall_is_topped_up(spark):
    rows = categorised(build(spark, {("a", "b"): 400}))
    plan = spark.createDataFrame([("a", "b", 90, 0.05)], "question_type string, difficulty string, n_taken long, accept double")
    assert draw(rows, plan).count() == 90
    assert expected_shortfall(10_000, 500) < 1e-6


def test_small_shares_are_spread_over_buckets(spark):
    """Accepted rows are the lowest part of the range; buckets cut that part."""
    from pyspark.sql import functions as F

    from millrace.llm import sampling

    seen = []
    true_durable = sampling.durable
    sampling.durable = lambda df, label="t": seen.append(true_durable(df, label)) or seen[-1]
    try:
        rows = categorised(spark.range(200_000).select(F.col("id").alias("triple_id"), F.lit("a").alias("question_type"), F.lit("b").alias("difficulty")))
        plan = spark.createDataFrame([("a", "b", 20, 0.00025)], "question_type string, difficulty string, n_taken long, accept double")
        got = sorted(r.triple_id for r in draw(rows, plan).collect())
    finally:
        sampling.durable = true_durable
    assert got == sorted(r.triple_id for r in rows.orderBy("u", "triple_id").limit(20).collect())
    place = F.floor(F.col("u") / F.lit(2.0**60) / F.col("accept") * sampling.BUCKETS)
    assert seen[0].select(place.alias("p")).distinct().count() > 0.8 * seen[0].count() > 20


def test_empty_and_nulls(spark):
    targets = spark.createDataFrame([("a", "b", 1000, 3)], TARGET)
    sample, report = stratified_sample(spark.createDataFrame([], TRIPLE), targets)
    assert sample.count() == 0 and report.first().deficit == 3
    sample, report = stratified_sample(spark.createDataFrame([(None, "a", "b", "", "")], TRIPLE), spark.createDataFrame([(None, None, None, None)], TARGET))
    assert sample.count() == 0 and report.first().needed == 0
