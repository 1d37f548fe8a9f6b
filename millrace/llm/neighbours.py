"""Problem 1: the most similar vectors of every vector, by a permutation index.

A vector is represented by the order of the pivots nearest to it. It is posted in the inverted
lists of its first few pivots; inside a list, members are ranked for each other by the footrule
distance between their orders, and the better half is reranked by exact cosine similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable

#: Copies of a row of a small side in a join with a side that one key may dominate.
SALTS = 32


@dataclass(frozen=True)
class IndexParameters:
    """``vectors_per_pivot`` sets how many pivots are drawn: their number grows with the vectors, so
    lists stay about ``vectors_per_pivot x posted`` long at every size. Pivots are drawn uniformly,
    so crowded regions get as many as they have vectors.

    Pivots have pivots: one in ``region`` of them is the centre of a region, every pivot belongs to
    its nearest centre, and a vector's order is taken over the pivots of its ``looked`` nearest
    regions. Centres are broadcast (``max_centres`` bounds them; beyond, regions get larger); pivots
    are broadcast up to ``broadcast_pivots`` and joined by region beyond.

    ``reranked`` is the share of a list that footrule leaves to be reranked, at least ``least``
    members. ``block`` bounds the members that one task compares at a time.
    """

    k: int = 10
    min_similarity: float = -1.0
    dimension: int = 64
    vectors_per_pivot: int = 128
    posted: int = 10
    prefix: int = 14
    reranked: float = 0.5
    least: int = 64
    region: int = 128
    looked: int = 8
    max_centres: int = 262_144
    broadcast_pivots: int = 65_536
    block: int = 4_096
    seed: int = 11


def usable_vectors(table: DataFrame, p: IndexParameters = IndexParameters(), ident: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``(chunk_id, embedding)``, one row per id, of the vectors that take part: not null, of the
    right length, no null, NaN or infinite number, not all zero. Rows without an id take no part;
    of rows repeating one, one counts (the greatest vector in array order).
    """
    rows = table.select(F.col(ident).alias("chunk_id"), F.col(vector).cast("array<float>").alias("embedding"))
    rows = rows.where(F.col("chunk_id").isNotNull() & (F.size("embedding") == p.dimension))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("chunk_id").agg(F.max("embedding").alias("embedding"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest values of each row, greatest first, ties by column."""
    if k < values.shape[1]:
        best = np.argpartition(-values, k - 1, axis=1)[:, :k]
        best.sort(axis=1)
    else:
        best = np.tile(np.arange(values.shape[1]), (len(values), 1))
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(values, best, 1), axis=1, kind="stable"), 1)


@dataclass
class Pivots:
    """Centres, and pivots in the order of their regions; region g has ``starts[g]:starts[g + 1]``."""

    centres: np.ndarray
    pivots: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, centres: np.ndarray, pivots: np.ndarray) -> Pivots:
        home = nearest_regions(pivots, centres, 1)[:, 0] if len(pivots) else np.zeros(0, int)
        order = np.argsort(home, kind="stable")
        return cls(centres, pivots[order], np.searchsorted(home[order], np.arange(len(centres) + 1)))

    def orders(self, units: np.ndarray, looked: int, prefix: int) -> np.ndarray:
        """For each row the numbers of its ``prefix`` nearest pivots among those of its nearest
        regions, nearest first; padded with numbers that no pivot has."""
        regions = nearest_regions(units, self.centres, looked)
        width = min(prefix, max(1, int(np.diff(self.starts).max())))
        near = np.full((len(units), regions.shape[1], width), -np.inf, np.float32)
        number = np.full(near.shape, -1, np.int64)
        flat = np.argsort(regions, axis=None, kind="stable")
        at = np.searchsorted(regions.ravel()[flat], np.arange(len(self.centres) + 1))
        for g in np.flatnonzero(np.diff(at)):
            first, last = self.starts[g], self.starts[g + 1]
            if first < last:
                row, slot = np.divmod(flat[at[g] : at[g + 1]], regions.shape[1])
                sims = units[row] @ self.pivots[first:last].T
                top = _top(sims, width)
                near[row, slot, : top.shape[1]] = np.take_along_axis(sims, top, 1)
                number[row, slot, : top.shape[1]] = first + top
        return first_of(number.reshape(len(units), -1), near.reshape(len(units), -1), prefix)


def first_of(number: np.ndarray, near: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest numbers of each row; places without a pivot hold -1, -2, ..."""
    top = _top(near, min(prefix, near.shape[1]))
    out = np.tile(-1 - np.arange(prefix), (len(near), 1))
    picked = np.take_along_axis(number, top, 1)
    out[:, : top.shape[1]] = np.where(picked >= 0, picked, out[:, : top.shape[1]])
    return out


def nearest_regions(units: np.ndarray, centres: np.ndarray, looked: int) -> np.ndarray:
    out = np.empty((len(units), min(looked, len(centres))), np.int64)
    step = max(64, 4_000_000 // max(1, len(centres)))
    for s in range(0, len(units), step):
        out[s : s + step] = _top(units[s : s + step] @ centres.T, out.shape[1])
    return out


def footrule_closeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Spearman footrule between all pairs of pivot orders, as a closeness (larger is nearer).

    With a missing pivot counted at place ``prefix``, the distance of two orders is a constant less
    twice the sum, over the pivots they share, of min(prefix - place, prefix - place). The sum is
    gathered place by place of the left orders from a table (pivot x right row) of the right rows'
    weights, which are cut off at the weight of that place. Negative numbers are no pivots.
    """
    prefix = left.shape[1]
    pivots, place = np.unique(right if left is right else np.concatenate([left, right]), return_inverse=True)
    place = place.reshape(-1, prefix)
    mine, theirs = place[: len(left)], place[-len(right) :]
    kind = np.uint8 if prefix < 22 else np.uint16
    table, column = np.zeros((len(pivots), len(right)), kind), np.arange(len(right))
    cells = []
    for j in range(prefix):
        real = right[:, j] >= 0
        cells.append((theirs[real, j], column[real]))
        table[cells[j]] = prefix - j
    close = np.zeros((len(left), len(right)), kind)
    step = max(16, 131_072 // max(1, len(right)))
    held = np.empty((step, len(right)), kind)
    for j in range(prefix):
        for cell in cells[:j]:
            table[cell] = prefix - j
        for s in range(0, len(left), step):
            part = mine[s : s + step, j]
            close[s : s + step] += np.take(table, part, axis=0, out=held[: len(part)], mode="clip")
    return close


def _rerank(left: np.ndarray, right: np.ndarray, own: np.ndarray | None, close: np.ndarray, p: IndexParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and similarities of the k most similar of those that footrule left (and of all
    that tie with the last to 6 decimals). ``left``, ``right`` are unit vectors, ``own`` the columns
    of the rows themselves."""
    m, c = len(right), max(p.least, int(p.reranked * len(right)))
    small = left.astype(np.float32) @ right.astype(np.float32).T
    if c < m:
        # the place of the last one kept is found in every eighth column
        part = close[:, ::8]
        kept = max(1, part.shape[1] * c // m)
        far = close < np.partition(part, part.shape[1] - kept, axis=1)[:, part.shape[1] - kept][:, None]
        small -= far.view(np.uint8) << 2
    if own is not None:
        small[np.arange(len(left)), own] = -4
    k, width = min(p.k, m), m // 16
    # the k-th greatest of the maxima of columns taken together is no greater than the k-th value
    top = small[:, : width * 16].reshape(len(left), 16, width).max(1) if width >= 4 * k else small
    edge = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k]
    found = np.flatnonzero(small >= np.maximum(edge - 4e-6, max(-1.5, p.min_similarity - 4e-6))[:, None])
    row, col = np.divmod(found, m)
    return row, col, np.round((left[row] * right[col]).sum(1), 6)


def compare(ids: np.ndarray, units: np.ndarray, orders: np.ndarray, other: np.ndarray | None, p: IndexParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best partners inside one list: ids, partners and similarities, sorted by id and rank.
    ``other`` marks the rows of the second block of a split list: then only pairs across the blocks
    are compared, in both directions."""
    every = np.arange(len(ids))
    sides = [(every, every)] if other is None else [(np.flatnonzero(~other), np.flatnonzero(other)), (np.flatnonzero(other), np.flatnonzero(~other))]
    rows, cols, sims = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for mine, theirs in sides:
        if not len(mine) or not len(theirs):
            continue
        right = units[theirs]
        step = max(64, 16_000_000 // len(theirs))
        for s in range(0, len(mine), step):
            part = mine[s : s + step]
            close = footrule_closeness(orders, orders) if len(part) == len(ids) else footrule_closeness(orders[part], orders[theirs])
            fine = max(16, 131_072 // len(theirs))
            for t in range(0, len(part), fine):
                some = part[t : t + fine]
                row, col, sim = _rerank(units[some], right, some if other is None else None, close[t : t + fine], p)
                rows.append(some[row])
                cols.append(theirs[col])
                sims.append(sim)
    row, there, sim = np.concatenate(rows), ids[np.concatenate(cols)], np.concatenate(sims)
    order = np.lexsort((there, -sim, row))
    row, there, sim = row[order], there[order], sim[order]
    keep = (np.arange(len(row)) - np.searchsorted(row, row) < p.k) & (sim >= p.min_similarity)
    return ids[row[keep]], there[keep], sim[keep]


def _packed(ids: np.ndarray, there: np.ndarray, sims: np.ndarray, kind: pa.DataType) -> pa.Table:
    """One row per id with the list of its (negative similarity, partner)."""
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    ends = np.append(starts, len(ids)).astype(np.int32)
    hits = pa.StructArray.from_arrays([pa.array(-sims), pa.array(there, kind)], ["s", "neighbour"])
    return pa.table({"chunk_id": pa.array(ids[starts], kind), "hits": pa.ListArray.from_arrays(pa.array(ends), hits)})


def _salted(big: DataFrame, small: DataFrame, key: str, how: str) -> DataFrame:
    """A join on a key that may hold a third of the rows of ``big``."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _drawn(vectors: DataFrame, share: float, most: int, p: IndexParameters) -> DataFrame:
    """About ``share`` of the vectors, at most ``most``, by a hash of their ids."""
    draw = F.xxhash64(F.col("chunk_id"), F.lit(p.seed))
    some = vectors.where(draw <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else vectors
    return some.orderBy(draw, "chunk_id").limit(most)


def with_orders(vectors: DataFrame, total: int, p: IndexParameters) -> DataFrame:
    """``(chunk_id, embedding, places)``: each vector with the order of its nearest pivots."""
    spark = vectors.sparkSession
    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    wanted = max(min(total, 16), total // p.vectors_per_pivot)
    many = min(p.max_centres, -(-wanted // p.region))
    share = min(1.0, 1.2 * (wanted + 200) / total)
    unit = lambda column: _unit(_matrix(column, p.dimension)).astype(np.float32)
    centres = unit(_drawn(vectors, min(1.0, 1.2 * (many + 200) / total), many, p).select("embedding").toArrow()["embedding"])

    def rows(b: pa.RecordBatch, names: list[str], *columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("embedding"), *columns], ["chunk_id", "embedding", *names])

    def lists(v: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))

    if wanted <= p.broadcast_pivots:
        drawn = unit(_drawn(vectors, share, wanted, p).select("embedding").toArrow()["embedding"])
        shared = spark.sparkContext.broadcast(Pivots.of(centres, drawn))

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield rows(b, ["places"], lists(shared.value.orders(unit(b.column("embedding")), p.looked, p.prefix)))

        return vectors.mapInArrow(order, f"chunk_id {id_type}, embedding array<float>, places array<bigint>")

    # too many to broadcast: vectors go to their regions, where the pivots are
    held = spark.sparkContext.broadcast(centres)

    def place(looked: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield rows(b, ["regions"], lists(nearest_regions(unit(b.column("embedding")), held.value, looked)))

        return run

    kind = f"chunk_id {id_type}, embedding array<float>, regions array<bigint>"
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(8)).cast("int")
    pivots = durable(_drawn(vectors, share, wanted, p).mapInArrow(place(1), kind), "pivots")
    pivots = pivots.select(F.col("regions")[0].alias("_g"), F.xxhash64("chunk_id").bitwiseAND(F.lit(2**63 - 1)).alias("pivot"), F.col("embedding").alias("centre"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_s"))
    asked = vectors.mapInArrow(place(p.looked), kind).select("chunk_id", "embedding", F.explode("regions").alias("_g"), number("chunk_id").alias("_s"))

    def near(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"chunk_id": mine["chunk_id"].slice(0, 0), "_n": pa.array([], pa.list_(pa.struct([("s", pa.float32()), ("pivot", pa.int64())])))})
        v, c, number = unit(mine["embedding"]), unit(theirs["centre"]), theirs["pivot"].to_numpy()
        width, found, sims = min(p.prefix, len(c)), [], []
        for s in range(0, len(v), 4096):
            near = v[s : s + 4096] @ c.T
            top = _top(near, width)
            found.append(number[top])
            sims.append(np.take_along_axis(near, top, 1))
        hits = pa.StructArray.from_arrays([pa.array(-np.concatenate(sims).ravel()), pa.array(np.concatenate(found).ravel())], ["s", "pivot"])
        return pa.table({"chunk_id": mine["chunk_id"], "_n": pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) * width + 1, width, dtype=np.int32)), hits)})

    parts = asked.groupBy("_g", "_s").cogroup(pivots.groupBy("_g", "_s")).applyInArrow(near, f"chunk_id {id_type}, _n array<struct<s:float,pivot:bigint>>")
    best = parts.groupBy("chunk_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_n"))), 1, p.prefix).alias("_n"))
    padded = F.concat(F.transform("_n", lambda e: e["pivot"]), F.transform(F.sequence(F.lit(1), F.lit(p.prefix)), lambda i: -i.cast("long")))
    return vectors.join(best.select("chunk_id", F.slice(padded, 1, p.prefix).alias("places")), "chunk_id")


def all_neighbours(table: DataFrame, p: IndexParameters = IndexParameters(), ident: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``(chunk_id, neighbour, similarity, rank)``: the k most similar vectors of every vector.

    Cosine similarity rounded to 6 decimals, ties by smaller id; only partners of at least
    ``min_similarity``. All vectors are indexed and all are queries. Approximate in that a partner
    sharing none of the first ``posted`` pivots, or in the worse part of every shared list by
    footrule, is missed; similarities that come out are exact.

    Vectors of one direction (to 6 decimals) have similarity 1 to each other: of such a group, the
    k + 1 smallest ids enter the index, the others take over the list of the group's first member.
    So copies, a third of all rows if need be, never meet in a list. Lists longer than ``block``
    are split into blocks, and each pair of blocks is a task of its own. Without two usable vectors
    the result is empty.
    """
    spark = table.sparkSession
    valid = usable_vectors(table, p, ident, vector)
    id_type = valid.schema["chunk_id"].dataType.simpleString()
    codes = np.random.default_rng(p.seed).integers(-(2**62), 2**62, p.dimension) * 2 + 1

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                steps = np.rint(_unit(_matrix(b.column("embedding"), p.dimension)) * 1e6).astype(np.int64)
                with np.errstate(over="ignore"):
                    mixed = steps @ codes
                    mixed ^= mixed >> 29
                yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("embedding"), pa.array(mixed)], ["chunk_id", "embedding", "_dir"])

    valid = valid.mapInArrow(directions, f"chunk_id {id_type}, embedding array<float>, _dir long")
    valid = durable(valid, "vectors")
    total = valid.count()
    if total < 2:
        return spark.createDataFrame([], f"chunk_id {id_type}, neighbour {id_type}, similarity double, rank int")

    # groups of one direction; the rank filter also prunes before the shuffle, so a group that holds
    # a third of all rows sends k + 1 rows a task
    place = F.row_number().over(Window.partitionBy("_dir").orderBy("chunk_id"))
    active = valid.select("_dir", "chunk_id").withColumn("_place", place).where(F.col("_place") <= p.k + 1)
    crowded = durable(active.where(F.col("_place") == p.k + 1).select("_dir"), "crowded")
    many = not crowded.isEmpty()
    indexed = valid
    if many:
        heads = active.join(crowded, "_dir").select("chunk_id")
        others = _salted(valid, crowded, "_dir", "left_semi").join(heads, "chunk_id", "left_anti")
        indexed = valid.join(others.select("chunk_id"), "chunk_id", "left_anti")
        total = indexed.count()

    ordered = durable(with_orders(indexed.select("chunk_id", "embedding"), total, p), "ordered")
    posted = F.explode(F.filter(F.slice("places", 1, p.posted), lambda x: x >= 0)).alias("pivot")
    posts = ordered.select("chunk_id", "embedding", "places", posted)
    long = durable(ordered.select(posted).groupBy("pivot").agg(F.count("*").alias("_n")).where(F.col("_n") > p.block).select("pivot", F.ceil(F.col("_n") / p.block).cast("int").alias("_blocks")), "long")
    n_long = long.count()
    if n_long:
        posts = posts.join(F.broadcast(long) if n_long <= 100_000 else long, "pivot", "left")
        mine = F.pmod(F.xxhash64("chunk_id", F.lit(p.seed + 1)), F.coalesce("_blocks", F.lit(1))).cast("int")
        posts = posts.withColumn("_mine", mine).withColumn("_with", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
        posts = posts.select("chunk_id", "embedding", "places", "pivot", F.least("_mine", "_with").alias("lo"), F.greatest("_mine", "_with").alias("hi"), "_mine")
    else:
        posts = posts.select("*", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("_mine"))

    def search(t: pa.Table) -> pa.Table:
        ids = t["chunk_id"].to_numpy()
        units, orders = _unit(_matrix(t["embedding"], p.dimension)), _matrix(t["places"], p.prefix)
        mine, hi = t["_mine"].to_numpy(), t["hi"][0].as_py()
        return _packed(*compare(ids, units, orders, mine == hi if t["lo"][0].as_py() != hi else None, p), t["chunk_id"].type)

    hits = posts.groupBy("pivot", "lo", "hi").applyInArrow(search, f"chunk_id {id_type}, hits array<struct<s:double,neighbour:{id_type}>>")
    nearest = _merged(hits, p)
    if not many:
        return nearest
    nearest = durable(nearest, "nearest")
    first = active.join(crowded, "_dir").where(F.col("_place") == 1).select("_dir", F.col("chunk_id").alias("_head"))
    taken = first.join(nearest.withColumnRenamed("chunk_id", "_head"), "_head").select("_dir", "neighbour", "similarity")
    taken = taken.unionByName(first.select("_dir", F.col("_head").alias("neighbour"), F.lit(1.0).alias("similarity")))
    taken = taken.groupBy("_dir").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "neighbour"))), 1, p.k).alias("_l"))
    copies = _salted(others.select("chunk_id", "_dir"), taken, "_dir", "inner").select("chunk_id", F.posexplode("_l").alias("rank", "_e"))
    copies = copies.select("chunk_id", "_e.neighbour", (-F.col("_e.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))
    return nearest.unionByName(copies)


def _merged(hits: DataFrame, p: IndexParameters) -> DataFrame:
    """The k best distinct partners of each id; at most posted x k of them met in its lists."""
    got = hits.groupBy("chunk_id").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("_l"))
    got = got.select("chunk_id", F.posexplode(F.slice(F.array_sort("_l"), 1, p.k)).alias("rank", "_e"))
    return got.select("chunk_id", "_e.neighbour", (-F.col("_e.s")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs of which one is among the nearest of the other."""
    a, b = F.least("chunk_id", "neighbour"), F.greatest("chunk_id", "neighbour")
    return neighbours.select(a.alias("chunk_a"), b.alias("chunk_b")).distinct()
