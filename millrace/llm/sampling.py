"""Problem 6: a sample whose category shares match targets, with a report of targets not met."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..operators.ordering import digest
from ..session import durable
from .common import label

KEYS = ["question_type", "difficulty"]
#: Oversampling in standard deviations of the binomial count; a shortfall is topped up all the same.
SIGMAS = 6.0
SEED = 20_240_601
#: Buckets that the accepted rows of a category are cut into.
BUCKETS = 4_096


def categorised(triples: DataFrame) -> DataFrame:
    """``(triple_id, question_type, difficulty, u)``, one row per triple.

    Labels are trimmed and in lower case, null or blank reads ``unknown``. Rows without a
    ``triple_id`` take no part; of rows repeating one the smallest pair of labels counts. ``u`` is
    the triple's 60-bit digest, its place in the draw.
    """
    rows = triples.select(F.col("triple_id"), *(label(F.col(k)).alias(k) for k in KEYS)).where("triple_id is not null")
    one = rows.groupBy("triple_id").agg(F.min(F.struct(*KEYS)).alias("_k"))
    return one.select("triple_id", *(F.col(f"_k.{k}").alias(k) for k in KEYS), digest(SEED, F.col("triple_id")).alias("u"))


def sample_plan(rows: DataFrame, targets: DataFrame, divisor: int = 5) -> DataFrame:
    """Per row of ``targets``: what is there, needed and to be taken.

    The sample size is n div ``divisor``; ``needed`` is the larger of ``min_keep`` and
    (size x target_permille) div 1000.
    ``accept`` is the acceptance probability: the target-to-observed ratio with an allowance of
    ``SIGMAS`` deviations. Null in a target's numbers reads 0; targets of one category add up.
    """
    counts = rows.groupBy(*KEYS).agg(F.count("*").alias("n_available"))
    goal = targets.select(*(label(F.col(k)).alias(k) for k in KEYS), F.coalesce("target_permille", F.lit(0)).cast("long").alias("target_permille"), F.coalesce("min_keep", F.lit(0)).cast("long").alias("min_keep"))
    goal = goal.groupBy(*KEYS).agg(F.sum("target_permille").alias("target_permille"), F.sum("min_keep").alias("min_keep"))
    size = counts.agg((F.coalesce(F.sum("n_available"), F.lit(0).cast("long"))).alias("n_all"))
    plan = goal.join(counts, KEYS, "left").crossJoin(size).withColumn("n_available", F.coalesce("n_available", F.lit(0).cast("long")))
    plan = plan.withColumn("needed", F.greatest("min_keep", F.expr(f"((n_all div {divisor}) * target_permille) div 1000")))
    plan = plan.withColumn("n_taken", F.least("needed", "n_available"))
    spare = F.col("n_taken") + SIGMAS * F.sqrt("n_taken") + SIGMAS
    accept = F.when(F.col("n_available") == 0, 0.0).otherwise(F.least(F.lit(1.0), spare / F.col("n_available")))
    return plan.select(*KEYS, "target_permille", "min_keep", "n_available", "needed", "n_taken", accept.alias("accept"))


_RULE = StructType([*(StructField(k, StringType()) for k in KEYS), StructField("n_taken", LongType()), StructField("accept", DoubleType())])


def draw(rows: DataFrame, plan: DataFrame, max_targets: int = 100_000) -> DataFrame:
    """The sample: exactly ``n_taken`` rows of every category of ``plan``.

    Each row is accepted by itself where its hash lies below the category's probability. Counts
    of accepted rows are then corrected exactly: surplus rows are those with the largest (u,
    triple_id). Only the bucket of hashes in which the n-th row lies is sorted, so a category of a
    third of all rows is never ranked in one task. Should a category have accepted too few (beyond
    six deviations), its probability is doubled and it is drawn again, until it has enough.

    ``plan`` comes from a table of targets, which is small by nature; more than ``max_targets``
    categories are refused, as the plan is held by the driver.
    """
    spark = rows.sparkSession
    head = plan.select(*KEYS, "n_taken", "accept").where("n_taken > 0").limit(max_targets + 1).collect()
    if len(head) > max_targets:
        raise ValueError(f"more than {max_targets} target categories")
    rules = {(r[0], r[1]): (int(r[2]), float(r[3])) for r in head}
    done = None
    while True:
        table = spark.createDataFrame([(*k, n, p) for k, (n, p) in rules.items()], _RULE)
        chance = F.col("u") / F.lit(2.0**60)
        hit = durable(rows.join(F.broadcast(table), KEYS).where(chance < F.col("accept")), "accepted")
        # buckets cut the accepted range of the category, however small it is
        hit = hit.withColumn("_bucket", F.least(F.floor(F.col("u") / F.lit(2.0**60) / F.col("accept") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        held = hit.groupBy(*KEYS, "_bucket").agg(F.count("*").alias("_n"), F.first("n_taken").alias("n_taken"))
        upto = Window.partitionBy(*KEYS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        held = held.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        spread = hit.join(held.select(*KEYS, "_bucket", "_before", "_n"), [*KEYS, "_bucket"])
        inside = spread.where(F.col("_before") + F.col("_n") <= F.col("n_taken"))
        edge = spread.where((F.col("_before") < F.col("n_taken")) & (F.col("_before") + F.col("_n") > F.col("n_taken")))
        edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("u", "triple_id")))
        edge = edge.where(F.col("_before") + F.col("_r") <= F.col("n_taken"))
        part = inside.select("triple_id", *KEYS).unionByName(edge.select("triple_id", *KEYS))
        got = {(r[0], r[1]): r[2] for r in hit.groupBy(*KEYS).count().collect()}
        short = {k: v for k, v in rules.items() if got.get(k, 0) < v[0] and v[1] < 1.0}
        if short:
            part = part.join(F.broadcast(spark.createDataFrame([(*k, *v) for k, v in short.items()], _RULE).select(*KEYS)), KEYS, "left_anti").select("triple_id", *KEYS)
        done = part if done is None else done.unionByName(part)
        if not short:
            return done
        rules = {k: (n, min(1.0, 2 * p)) for k, (n, p) in short.items()}


def stratified_sample(triples: DataFrame, targets: DataFrame, divisor: int = 5) -> tuple[DataFrame, DataFrame]:
    """(sample, report). The report has one row per target category: what was there, needed and
    drawn, and the deficit, counted in the drawn rows."""
    rows = durable(categorised(triples), "categorised")
    plan = durable(sample_plan(rows, targets, divisor), "plan")
    sample = draw(rows, plan)
    counts = sample.groupBy(*KEYS).agg(F.count("*").alias("n_drawn"))
    report = plan.drop("accept", "n_taken").join(counts, KEYS, "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0).cast("long")))
    return sample, report.withColumn("deficit", F.col("needed") - F.col("n_drawn"))


def expected_shortfall(n: int, taken: int) -> float:
    """Chance that a category accepts too few in the first draw (normal bound), for the record."""
    p = min(1.0, (taken + SIGMAS * math.sqrt(taken) + SIGMAS) / max(n, 1))
    spread = math.sqrt(max(n * p * (1 - p), 1e-9))
    return 0.5 * math.erfc((n * p - taken) / spread / math.sqrt(2))
