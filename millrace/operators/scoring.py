"""Weighted scores, acceptance, second chances, averages, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import digest

# Weights of the criteria.
WEIGHTS = {"faithfulness": 0.30, "relevance": 0.25, "completeness": 0.20, "tone": 0.15, "follow_up_quality": 0.10}
WEIGHTS_MULTIHOP = {
    "faithfulness": 0.25, "relevance": 0.20, "completeness": 0.15, "tone": 0.10, "follow_up_quality": 0.10, "multi_hop_validity": 0.20,
}
RETRY_BAND, RETRY_FLOOR = 0.15, 0.3


def clean(x: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(x), x)


def weighted(scores: Column, weights: dict[str, float], fields: set[str]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        if name in fields:
            total = total + F.coalesce(clean(scores[name]), F.lit(0.0)) * weight
    return total


def overall_score(scores: Column, question_type: Column, fields: set[str]) -> Column:
    """Weighted sum of the criteria, missing ones 0; multi-hop questions have weights of their own.
    ``fields`` names the criteria that the struct has."""
    return F.when(F.coalesce(F.lower(F.trim(question_type)) == "multihop", F.lit(False)), weighted(scores, WEIGHTS_MULTIHOP, fields)).otherwise(weighted(scores, WEIGHTS, fields))


def verdict(score: Column, threshold: float = 0.7) -> Column:
    """accepted, borderline or rejected; a missing score is rejected.

    Borderline scores lie at most 0.15 under the threshold, but not under 0.3, and may be judged
    again.
    """
    s = F.coalesce(clean(score), F.lit(0.0))
    low = max(threshold - RETRY_BAND, RETRY_FLOOR)
    return F.when(s >= threshold, "accepted").when((s >= low) & (s < threshold), "borderline").otherwise("rejected")


def apply_retries(judged: DataFrame, retried: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """Scores after a second judgement: a retry replaces a score only if it passes."""
    second = retried.select(key, F.col("quality_score").alias("_again"))
    out = judged.join(second, key, "left")
    return out.withColumn("quality_score", F.when(clean(F.col("_again")) >= threshold, F.col("_again")).otherwise(F.col("quality_score"))).drop("_again")


def average_scores(judged: DataFrame, recovered: DataFrame) -> DataFrame:
    """Mean over first judgements, and mean in which recovered rows count with both."""
    first = judged.select(clean(F.col("quality_score")).alias("s"))
    both = first.unionByName(recovered.select(clean(F.col("quality_score")).alias("s")))
    return first.agg(F.round(F.avg("s"), 3).alias("avg_first")).crossJoin(both.agg(F.round(F.avg("s"), 3).alias("avg_with_retries")))


def criteria_averages(judged: DataFrame, scores: str, names: list[str]) -> DataFrame:
    """``(criterion, average, n)`` with 3 decimals over the rows that have the criterion."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("criterion"), clean(F.col(f"{scores}.{n}")).alias("score")) for n in names)))
    long = judged.select(pairs.alias("_p")).select("_p.*").where("score is not null")
    return long.groupBy("criterion").agg(F.round(F.avg("score"), 3).alias("average"), F.count("*").alias("n"))


def exact_sample(df: DataFrame, key: str, share: float = 0.3, seed: int = 1) -> DataFrame:
    """max(1, min(n, floor(n x share))) rows, those with the smallest seeded digests.

    Digests are counted in buckets, and only the bucket in which the last row lies is sorted.
    """
    n = df.count()
    want = max(1, min(n, int(n * share)))
    rows = df.withColumn("_h", digest(seed, F.col(key))).withColumn("_b", F.shiftright("_h", 48))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.join(sizes.withColumn("_before", upto - F.col("_n")), "_b")
    whole = placed.where(F.col("_before") + F.col("_n") <= want)
    edge = placed.where((F.col("_before") < want) & (F.col("_before") + F.col("_n") > want))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).where(F.col("_before") + F.col("_r") <= want).drop("_r")
    return whole.unionByName(edge).drop("_h", "_b", "_n", "_before")


def bernoulli_sample(df: DataFrame, key: str, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """Each row with the given chance, decided by its own digest."""
    return df.where(F.pmod(digest(seed, F.col(key)), F.lit(1_000_000)) < int(rate * 1_000_000))


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric where present, 3 decimals, and the number of rows."""
    return df.agg(*(F.round(F.avg(clean(F.col(m))), 3).alias(f"avg_{m}") for m in metrics), F.count("*").alias("sample_size"))


def quality_report(judged: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row of totals over judged rows."""
    s = clean(F.col("quality_score"))
    v = verdict(F.col("quality_score"), threshold)
    return judged.agg(
        F.count("*").alias("total_evaluated"), F.count_if(v == "accepted").alias("total_validated"), F.count_if(v != "accepted").alias("total_rejected"),
        F.count_if(v == "borderline").alias("total_borderline"), F.count_if(s.isNull()).alias("failed_validation"), F.round(F.avg(s), 3).alias("avg_quality_score"),
    )
