"""Vector functions on array columns, and exact top-k search by blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Largest side, in rows and in bytes of its matrix, that a search hands to every task; beyond either
#: both sides are blocked.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20
#: Rows of a block on either side when both are blocked.
BLOCK_ROWS = 4_096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is zero, lengths differ or a vector is null."""
    size = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)
    return F.coalesce(value, F.lit(0.0))


def normalise(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "embedding") -> DataFrame:
    """Unweighted mean of each group's vectors, element by element, with map-side combine."""
    long = df.select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    means = long.groupBy(*keys, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_v"))
    return packed.select(*keys, F.transform("_v", lambda e: e["_m"]).alias(out))


def adjacent_similarity(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Similarity of each row to the next one of its group, null for the last.

    ``order`` is a number without repeats. Rows are numbered inside their group by bucketed totals
    and joined to the next number, so no task has a whole group.
    """
    from ..operators.ordering import numbered

    rows = numbered(df.select(group, order, vector), [group], order, "_no")
    following = rows.select(group, (F.col("_no") - 1).alias("_no"), F.col(vector).alias("_next"))
    return rows.join(following, [group, "_no"], "left").select(group, order, F.when(F.col("_next").isNotNull(), cosine(F.col(vector), F.col("_next"))).alias("similarity"))


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), np.float64)
    size = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(size > 0, size, 1.0)


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, units: np.ndarray, k: int, same: bool, upto: float = 6) -> pd.DataFrame:
    out = []
    for s in range(0, len(q), 1024):
        sims = np.round(q[s : s + 1024] @ units.T, upto)
        if same:
            sims[query_ids[s : s + 1024][:, None] == ids[None, :]] = -np.inf
        c = min(k, len(ids))
        if c < len(ids):
            # everything that ties with the k-th value takes part, so that ties go to smaller ids
            edge = -np.partition(-sims, c - 1, axis=1)[:, c - 1 : c]
            rows, cols = np.nonzero(sims >= edge)
        else:
            rows, cols = np.nonzero(np.isfinite(sims))
        values = sims[rows, cols]
        order = np.lexsort((ids[cols], -values, rows))
        rows, cols, values = rows[order], cols[order], values[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = (place < k) & np.isfinite(values)
        out.append(pd.DataFrame({"query_id": query_ids[s : s + 1024][rows[keep]], "item_id": ids[cols[keep]], "similarity": values[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": query_ids, "item_id": ids[:0], "similarity": np.zeros(0)})


def _size(items: DataFrame) -> tuple[int, bool]:
    """Number of rows, and whether their matrix may be broadcast."""
    row = items.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("width")).first()
    return row["n"], row["n"] <= BROADCAST_ROWS and 8 * row["n"] * row["width"] <= BROADCAST_BYTES


def exact_top_k(queries: DataFrame, items: DataFrame, k: int, same: bool = False) -> DataFrame:
    """``(query_id, item_id, similarity, rank)``: the k most similar items of each query, exactly.

    Both inputs have ``(id, embedding)`` of equal lengths. Similarities are cosines rounded to 6
    decimals, ties by smaller id. ``same``: an item is not its own neighbour.

    The number of items is counted first. Up to ``BROADCAST_ROWS`` of them, and ``BROADCAST_BYTES``, are broadcast as one
    matrix and each batch of queries is a matrix product. Beyond, both sides are hashed into blocks
    and every pair of blocks is a task; the work stays quadratic, which exactness costs, but no task
    holds more than two blocks.
    """
    spark = queries.sparkSession
    queries = queries.select("id", "embedding").where("id is not null and embedding is not null")
    items = items.select("id", "embedding").where("id is not null and embedding is not null")
    id_type = queries.schema["id"].dataType.simpleString()
    shape = f"query_id {id_type}, item_id {items.schema['id'].dataType.simpleString()}, similarity double"
    n, fits = _size(items)
    if n == 0:
        return spark.createDataFrame([], shape + ", rank int")
    if fits:
        held = items.orderBy("id").toPandas()
        shared = spark.sparkContext.broadcast((held["id"].to_numpy(), _units(held["embedding"])))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, units = shared.value
            for b in batches:
                if len(b):
                    yield _best(b["id"].to_numpy(), _units(b["embedding"]), ids, units, k, same)

        parts = spark.sparkContext.defaultParallelism
        hits = queries.repartition(parts, "id").mapInPandas(search, shape)
    else:
        m = queries.count()
        nq, ni = -(-m // BLOCK_ROWS), -(-n // BLOCK_ROWS)
        left = queries.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(ni - 1))))
        right = items.withColumn("_i", F.pmod(F.xxhash64("id"), F.lit(ni)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

        def pair(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": a["id"][:0], "item_id": b["id"][:0], "similarity": np.zeros(0)})
            return _best(a["id"].to_numpy(), _units(a["embedding"]), b["id"].to_numpy(), _units(b["embedding"]), k, same)

        hits = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(pair, shape)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _over(ids: np.ndarray, q: np.ndarray, other: np.ndarray, units: np.ndarray, threshold: float, mirrored: bool) -> Iterator[pd.DataFrame]:
    """Pairs over the threshold, tile by tile; ``mirrored``: each pair is met from both sides."""
    for s in range(0, len(q), 512):
        for t in range(0, len(units), 4096):
            rows, cols = np.nonzero(np.round(q[s : s + 512] @ units[t : t + 4096].T, 6) > threshold)
            a, b = ids[s : s + 512][rows], other[t : t + 4096][cols]
            keep = a < b if mirrored else a != b
            a, b = a[keep], b[keep]
            yield pd.DataFrame({"src": a, "dst": b} if mirrored else {"src": np.where(a < b, a, b), "dst": np.where(a < b, b, a)})


def pairs_over(items: DataFrame, threshold: float) -> DataFrame:
    """``(src, dst)``, src < dst: every pair of ``(id, embedding)`` whose cosine, rounded to 6
    decimals, is over ``threshold``, however many partners an item has.

    Up to ``BROADCAST_ROWS`` items and ``BROADCAST_BYTES`` are broadcast as one matrix; beyond, every unordered pair of
    hashed blocks is a task, of blocks half as large since all their pairs may come out.
    """
    spark = items.sparkSession
    items = items.select("id", "embedding").where("id is not null and embedding is not null")
    kind = items.schema["id"].dataType.simpleString()
    shape = f"src {kind}, dst {kind}"
    n, fits = _size(items)
    if n < 2:
        return spark.createDataFrame([], shape)
    if fits:
        held = items.toPandas()
        shared = spark.sparkContext.broadcast((held["id"].to_numpy(), _units(held["embedding"])))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, units = shared.value
            for b in batches:
                if len(b):
                    yield from _over(b["id"].to_numpy(), _units(b["embedding"]), ids, units, threshold, True)

        return items.repartition(spark.sparkContext.defaultParallelism, "id").mapInPandas(search, shape)
    blocks = -(-n // max(1, BLOCK_ROWS // 2))
    placed = items.withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left = placed.withColumn("_a", F.col("_p")).withColumn("_b", F.explode(F.sequence("_p", F.lit(blocks - 1))))
    right = placed.toDF("id", "embedding", "_q").withColumn("_b", F.col("_q")).withColumn("_a", F.explode(F.sequence(F.lit(0), "_q")))

    def pair(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"src": a["id"][:0], "dst": a["id"][:0]})
        return pd.concat(_over(a["id"].to_numpy(), _units(a["embedding"]), b["id"].to_numpy(), _units(b["embedding"]), threshold, key[0] == key[1]))

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(pair, shape)


def band_pairs(neighbours: DataFrame, low: float = 0.4, high: float = 0.82) -> DataFrame:
    """Unordered pairs of which one is a neighbour of the other and whose similarity lies in
    [low, high]. ``neighbours`` comes from ``exact_top_k(..., same=True)`` with one fewer than the
    k that counts the vector itself."""
    near = neighbours.where(F.col("similarity").between(low, high))
    a, b = F.least("query_id", "item_id"), F.greatest("query_id", "item_id")
    return near.select(a.alias("id_a"), b.alias("id_b"), "similarity").distinct()
