"""Problems 3 and 5: capping records per contributor, and cutoffs that keep a fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordering import group_cutoffs, running_total, salted_key
from ..session import durable
from .common import file_of, usable

#: Salts of the first ranking: a contributor holding a third of all rows is ranked by so many tasks.
SALTS = 128
#: Most rows of one contributor that the second ranking may see in one task; larger caps are cut by
#: cutoffs instead.
MOST_RANKED = 1_000_000


def scored_records(df: DataFrame, ident: str = "id", path: str = "metadata.source_file", score: str = "metadata.quality_score") -> DataFrame:
    """``(ident, contributor, score)`` of the rows that take part, one row per ``ident``.

    Rows without a contributor (null or blank path) or a score (null or NaN) and rows without an
    ``ident`` take no part. Of rows that repeat an ``ident`` one counts: the one with the greatest
    (score, contributor). Other columns are never read. An empty table gives an empty result.
    """
    rows = df.select(F.col(ident).alias("ident"), file_of(F.col(path)).alias("contributor"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("ident").isNotNull() & F.col("contributor").isNotNull() & usable(F.col("score")))
    best = rows.groupBy("ident").agg(F.max(F.struct("score", "contributor")).alias("_b"))
    return best.select("ident", F.col("_b.contributor").alias("contributor"), F.col("_b.score").alias("score"))


def rank_split(records: DataFrame, cap: int | Column, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """Split records into those within and those beyond the best ``cap`` of their contributor.

    Order: higher score first, ties by smaller ``ident`` in byte order. ``cap`` is a number or an
    expression of columns of ``records`` that is constant within a contributor.

    First ranking: within (contributor, salt of ident). A row beyond the cap there is beyond it
    for good. Second ranking: within contributor, over at most salts x cap rows. So a dominant
    contributor is sorted by many tasks and none of its rows are dropped unseen. A number so large
    that the second ranking could see more than ``MOST_RANKED`` rows goes to ``cutoff_split``.
    """
    if isinstance(cap, int) and cap * salts > MOST_RANKED:
        return cutoff_split(records, cap)
    order = [F.desc("score"), F.asc("ident")]
    limit = F.lit(cap) if isinstance(cap, int) else cap
    pre = records.withColumn("_salt", salted_key(F.col("ident"), salts)).withColumn(
        "_pre", F.row_number().over(Window.partitionBy("contributor", "_salt").orderBy(*order))
    )
    final = pre.where(F.col("_pre") <= limit).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("contributor").orderBy(*order))
    )
    kept = final.where(F.col("_rank") <= limit).drop("_salt", "_pre", "_rank")
    gone = pre.where(F.col("_pre") > limit).drop("_salt", "_pre").unionByName(
        final.where(F.col("_rank") > limit).drop("_salt", "_pre", "_rank")
    )
    return kept, gone


def cutoff_split(records: DataFrame, cap: int, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """The same split for caps of any size, without a contributor's rows ever meeting in one task.

    The score of the cap-th best row is found by counting scores in buckets. Rows above it stay; of
    those that tie with it, the smallest idents fill what is left, ranked in buckets whose limits
    come from a sample of about 4,096 idents a contributor (it balances, ranks are exact).
    """
    cuts = group_cutoffs(records.select("contributor", "score"), "contributor", "score", F.least(F.lit(cap).cast("long"), F.col("n_rows")))
    cuts = durable(cuts.select("contributor", "cutoff", "n_kept"), "cuts")
    placed = durable(records.join(cuts, "contributor", "left"), "placed")  # a cap of 0 has no cutoff
    above, below = placed.where("score > cutoff"), placed.where("cutoff is null or score < cutoff")
    tied = placed.where("score = cutoff")
    size = tied.groupBy("contributor").agg(F.count("*").alias("_n"))
    drawn = tied.select("contributor", "ident").join(size, "contributor").where(F.pmod(F.xxhash64("ident"), F.greatest(F.lit(1), F.col("_n").cast("long") / 4_096).cast("long")) == 0)
    some = drawn.groupBy("contributor").agg(F.array_sort(F.collect_list("ident")).alias("_all"), F.first("_n").alias("_n"))
    at = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.get(F.col("_all"), F.floor(i * F.size("_all") / buckets).cast("int")))
    limits = size.join(some.select("contributor", F.filter(at, lambda x: x.isNotNull()).alias("_limits")), "contributor", "left")
    tied = tied.join(limits, "contributor").withColumn("_bucket", F.size(F.filter(F.coalesce("_limits", F.array().cast("array<string>")), lambda x: x <= F.col("ident").cast("string"))))
    tied = durable(tied.withColumn("_one", F.lit(1)), "tied")
    ranked = running_total(tied, ["contributor"], "_bucket", [F.asc("ident")], "_one", "_rank")
    fits = F.col("_rank") <= cap - (F.col("n_kept") - F.col("_n"))
    names = records.columns
    return above.select(names).unionByName(ranked.where(fits).select(names)), below.select(names).unionByName(ranked.where(~fits).select(names))


def cap_contributors(records: DataFrame, max_count: int | None = None, max_permille: int | None = None, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """Keep at most ``max_count`` records a contributor, or ``max_permille`` of all records, or the
    smaller of both; returns (kept, removed). A cap of 0 removes all rows.

    Caps are a count, or a share of the total taken as (n_total x permille) div 1000.
    """
    if max_count is None and max_permille is None:
        raise ValueError("give max_count, max_permille or both")
    if (max_count or 0) < 0 or (max_permille or 0) < 0:
        raise ValueError("a cap must not be negative")
    if max_permille is None:
        return rank_split(records, int(max_count), salts)
    total = records.agg(F.count("*").alias("n")).first()["n"]
    share = total * max_permille // 1000
    return rank_split(records, int(share if max_count is None else min(share, max_count)), salts)


def cap_report(records: DataFrame, cap: int) -> DataFrame:
    """Per contributor: records, records kept under the cap, records that go."""
    sizes = records.groupBy("contributor").agg(F.count("*").alias("n_records"))
    return sizes.select("contributor", "n_records", F.least("n_records", F.lit(cap).cast("long")).alias("n_kept"), F.greatest(F.col("n_records") - cap, F.lit(0).cast("long")).alias("n_removed"))


def fraction_cutoffs(records: DataFrame, numerator: int = 2, denominator: int = 5) -> DataFrame:
    """Per contributor the score of its k-th best record, k = n x numerator / denominator rounded up.

    Returns ``contributor, n_rows, n_target, cutoff, n_kept``; ``n_kept`` is at least ``n_target``
    and above it only by ties at the cutoff. Integer arithmetic throughout.
    """
    if not 0 < numerator <= denominator:
        raise ValueError("the fraction must lie in (0, 1]")
    wanted = F.expr(f"(n_rows * {numerator} + {denominator - 1}) div {denominator}")
    return group_cutoffs(records.select("contributor", "score"), "contributor", "score", wanted)


def keep_fraction(records: DataFrame, numerator: int = 2, denominator: int = 5) -> DataFrame:
    """The records scoring at least their contributor's cutoff, with that cutoff."""
    cuts = fraction_cutoffs(records, numerator, denominator).select("contributor", "cutoff")
    return records.join(cuts, "contributor").where(F.col("score") >= F.col("cutoff"))
