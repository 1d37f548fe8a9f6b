"""Exact positions, running totals and cutoffs inside groups of any size.

A plain ``Window.partitionBy(group)`` sorts a whole group in one task. Here a group is first cut
into *monotone buckets* (all of bucket b sorts before all of bucket b+1). Totals per bucket are
aggregated with map-side combine, their prefix sums are a tiny window, and only then is each bucket
sorted by itself. Results are exact whatever the bucket sizes; the buckets only spread the work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets a group is cut into for its local sorts.
BUCKETS = 256


def hash_bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a 64-bit hash that is monotone in the hash: its leading bits."""
    if buckets & (buckets - 1) or buckets < 2:
        raise ValueError("buckets must be a power of two")
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(2**63))), 64 - (buckets.bit_length() - 1)).cast("int")


def digest(seed: int, *keys: Column) -> Column:
    """60 bits of a digest of the keys: a place in a draw that any engine can compute."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def salted_key(key: Column, salts: int) -> Column:
    """A salt in [0, salts) derived from a row's own key, so that reruns agree."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def running_total(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[Column],
    value: str,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's rows up to and including this one.

    ``bucket`` must be monotone in ``order`` inside a group. ``df`` is read twice, so hand over a
    stored table. No task sees more than one bucket.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_mine"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("_mine").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(offsets, keys)
        .withColumn(out, F.col("_before") + F.sum(value).over(here))
        .drop("_before")
    )


def group_cutoffs(df: DataFrame, group: str, score: str, wanted: Column, buckets: int = BUCKETS) -> DataFrame:
    """Per group the score of its k-th best row, with the counts that belong to it.

    ``wanted`` gives k as an expression of ``n_rows`` (the group's size); groups with k < 1 are left
    out. Returns ``group, n_rows, n_target, cutoff, n_kept`` where ``n_kept`` counts the rows
    scoring at least the cutoff.

    Rows are first counted per (group, score), so ties never need sorting. The distinct scores of a
    group are cut into monotone buckets at splitters from a mergeable quantile sketch; the sketch
    only balances the buckets, counts and positions are exact.
    """
    classes = df.groupBy(group, score).agg(F.count("*").alias("_n"))
    shares = [i / buckets for i in range(1, buckets)]
    shape = classes.groupBy(group).agg(
        F.sum("_n").alias("n_rows"), F.percentile_approx(score, shares, 10 * buckets).alias("_split")
    )
    shape = shape.withColumn("n_target", wanted.cast("long")).where("n_target >= 1")
    spread = classes.join(shape, group).withColumn(
        "_bucket", F.size(F.filter("_split", lambda s: s > F.col(score)))
    )
    totals = spread.groupBy(group, "_bucket").agg(F.sum("_n").alias("_sum"), F.first("n_target").alias("_k"))
    upto = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        totals.withColumn("_upto", F.sum("_sum").over(upto))
        .where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_sum") < F.col("_k")))
        .select(group, "_bucket", (F.col("_upto") - F.col("_sum")).alias("_before"))
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        spread.join(hit, [group, "_bucket"])
        .withColumn("n_kept", F.col("_before") + F.sum("_n").over(inside))
        .where((F.col("n_kept") >= F.col("n_target")) & (F.col("n_kept") - F.col("_n") < F.col("n_target")))
        .select(group, "n_rows", "n_target", F.col(score).alias("cutoff"), "n_kept")
    )


def numbered(df: DataFrame, group: Sequence[str], key: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Add dense numbers from 0 in the order of a numeric, unique ``key`` inside each group.

    Equal-width buckets between a group's least and greatest key spread the sorting.
    """
    lows = df.groupBy(*group).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo") + 1) / buckets
    rows = df.join(lows, list(group)) if group else df.crossJoin(F.broadcast(lows))
    rows = rows.withColumn("_bucket", F.floor((F.col(key) - F.col("_lo")) / width).cast("int")).withColumn("_one", F.lit(1)).drop("_lo", "_hi")
    if group:
        done = running_total(rows, group, "_bucket", [F.col(key)], "_one", out)
    else:
        done = running_total(rows.withColumn("_all", F.lit(0)), ["_all"], "_bucket", [F.col(key)], "_one", out).drop("_all")
    return done.withColumn(out, F.col(out) - 1).drop("_bucket", "_one")
