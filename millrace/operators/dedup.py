"""Ordered near-duplicate elimination: an item goes when an earlier one that stays is too similar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import exact_top_k, norm, pairs_over
from ..session import durable

#: Neighbours of an item that the original pipeline looks at (its ten, less the item itself).
REFERENCE_NEIGHBOURS = 9


def duplicate_edges(items: DataFrame, threshold: float = 0.92, neighbours: int | None = None) -> DataFrame:
    """``(src, dst)``, src < dst: every pair more similar than ``threshold``.

    ``neighbours`` is the mode of the original pipeline (``REFERENCE_NEIGHBOURS``): dst must also be
    among so many nearest of src, equal similarities to the smaller ids, the item itself taking no
    slot. It loses links in groups larger than that.
    """
    if neighbours is None:
        return pairs_over(items, threshold)
    near = exact_top_k(items, items, neighbours, same=True)
    return near.where((F.col("similarity") > threshold) & (F.col("query_id") < F.col("item_id"))).select(F.col("query_id").alias("src"), F.col("item_id").alias("dst"))


def vector_classes(items: DataFrame, threshold: float = 0.92) -> DataFrame:
    """``(id, class_id, n_copies)``: one row per item; equal vectors share the smallest id.

    Vectors without a direction are similar to nothing, and at a threshold of 1 nothing is over it:
    such items are classes of their own.
    """
    size = norm(F.col("embedding"))
    alike = F.coalesce((size > 0) & (size < float("inf")), F.lit(False)) & F.lit(threshold < 1)
    marked = items.select("id", "embedding", alike.alias("_s"))
    some = marked.where("_s").select("id", "embedding")
    classes = some.groupBy("embedding").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    alone = marked.where("not _s").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"))
    return some.join(classes, "embedding").select("id", "class_id", "n_copies").unionByName(alone)


def greedy_survivors(ids: DataFrame, edges: DataFrame, key: str = "id", max_rounds: int = 10_000) -> DataFrame:
    """Keys that stay when items are visited in order and each one that stays removes its later
    neighbours.

    The same set without visiting in order: an item stays iff no item that stays points to it. Each
    round keeps the undecided items that no undecided item points to and drops what they point to.
    Only nodes with edges take part; rounds are as many as the longest alternating chain, not as
    many as items. Each round is a written table, so neither lineage nor a lost executor matters.
    """
    links = durable(edges.select("src", "dst").distinct(), "links")
    dropped = None
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        targets = links.select(F.col("dst").alias("src")).distinct()
        # sources that nothing undecided points to stay; what they point to goes
        roots = links.select("src").distinct().join(targets, "src", "left_anti")
        gone = durable(links.join(roots, "src", "left_semi").select(F.col("dst").alias(key)).distinct(), "gone")
        dropped = gone if dropped is None else dropped.union(gone)
        live = links.join(roots, "src", "left_anti")
        live = live.join(gone.select(F.col(key).alias("src")), "src", "left_anti").join(gone.select(F.col(key).alias("dst")), "dst", "left_anti")
        links = durable(live.select("src", "dst"), "links")
    else:
        raise RuntimeError("chains of duplicates are longer than max_rounds")
    if dropped is None:
        return ids.select(key)
    return ids.select(key).join(dropped.distinct(), key, "left_anti")


def deduplicate(items: DataFrame, threshold: float = 0.92, neighbours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(surviving items, one-row report) of ``(id, embedding, ...)``.

    Of equal vectors the first represents all: what removes one removes each, and a first one that
    stays removes the others. So only representatives are compared. ``neighbours`` as for the edges.
    """
    if neighbours is None:
        classes = durable(vector_classes(items, threshold), "classes")
        first = items.join(classes.where("id = class_id").select("id"), "id", "left_semi")
        stay = greedy_survivors(first, duplicate_edges(first, threshold), "id")
    else:
        stay = greedy_survivors(items, duplicate_edges(items, threshold, neighbours), "id")
    kept = items.join(stay, "id", "left_semi")
    before = items.agg(F.count("*").alias("before_dedup"))
    after = stay.agg(F.count("*").alias("after_dedup"))
    report = before.crossJoin(after).select("before_dedup", "after_dedup", (F.col("before_dedup") - F.col("after_dedup")).alias("duplicates_removed"), F.lit(threshold).alias("threshold"))
    return kept, report


def pair_preview(edges: DataFrame, n: int = 5) -> DataFrame:
    return edges.orderBy("src", "dst").limit(n)


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(content_hash, first_id, n_copies)`` of texts; null texts are left out."""
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.sha2(F.col(text), 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("_k").alias("first_id"), F.count("*").alias("n_copies"))


def copy_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, class_id, n_copies)``: one row per document with text; copies share the smallest key."""
    hashed = docs.where(F.col(text).isNotNull()).select(key, F.sha2(F.col(text), 256).alias("_h"))
    classes = hashed.groupBy("_h").agg(F.min(key).alias("class_id"), F.count("*").alias("n_copies"))
    return hashed.join(classes, "_h").drop("_h")


def item_links(items: DataFrame, edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """``(id, n_links, kept)``: one row per item with its number of links to near-duplicates.

    With ``classes`` of equal vectors the edges are those between representatives; links are counted
    over members without unfolding them.
    """
    links = durable(edges, "edges")
    both = links.select(F.col("src").alias("id"), F.col("dst").alias("_o")).unionAll(links.select("dst", "src"))
    if classes is None:
        ends = both.groupBy("id").agg(F.count("*").alias("_n"))
        stay = greedy_survivors(items, links).withColumn("_k", F.lit(True))
        out = items.select("id").join(ends, "id", "left").join(stay, "id", "left")
        return out.select("id", F.coalesce("_n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("_k", F.lit(False)).alias("kept"))
    first = classes.where("id = class_id")
    ends = both.join(first.select(F.col("id").alias("_o"), "n_copies"), "_o").groupBy("id").agg(F.sum("n_copies").alias("_n"))
    stay = greedy_survivors(first, links).withColumn("_k", F.lit(True))
    out = classes.join(ends.withColumnRenamed("id", "class_id"), "class_id", "left").join(stay, "id", "left")
    return out.select("id", (F.coalesce("_n", F.lit(0).cast("long")) + F.col("n_copies") - 1).alias("n_links"), F.coalesce("_k", F.lit(False)).alias("kept"))
