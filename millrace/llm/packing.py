"""Problem 7: filling fixed-capacity containers, by non-negative least squares on the histogram."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import hash_bucket, running_total
from ..session import durable
from .common import token_count

#: Cells that the solver sorts lengths into: a combination is enumerated over cells, and filled with
#: real lengths.
GRID = 512
#: Widest window under the capacity, as a share of it, in which combinations are looked for.
WINDOW = 8


def combinations(capacity: int, lengths: np.ndarray, window: int = 0, least: int = 0, rare: np.ndarray | None = None) -> np.ndarray:
    """All multisets of up to three of ``lengths`` whose sum lies in [capacity - window, capacity -
    least]; with ``rare`` (flags by length) those that hold one so marked.

    Rows are descending, padded with 0. With the sum fixed there are about capacity²/12 of them.
    """
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    ls = np.flatnonzero(have)
    found = []
    for total in range(max(1, capacity - window), capacity - least + 1):
        one = np.array([total] if have[total] else [], int)
        rest = total - ls
        two = ls[(rest > 0) & (rest <= ls) & have[np.clip(rest, 0, capacity)]]
        a, b = np.meshgrid(ls, ls, indexing="ij")
        c = total - a - b
        ok = (a >= b) & (b >= c) & (c > 0)
        a, b, c = a[ok], b[ok], c[ok]
        ok = have[c]
        found += [np.stack([one, 0 * one, 0 * one], 1), np.stack([two, total - two, 0 * two], 1), np.stack([a[ok], b[ok], c[ok]], 1)]
    out = np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)
    return out if rare is None else out[rare[out].any(1)]


def covering(capacity: int, lengths: np.ndarray) -> np.ndarray:
    """Exact fills, and for lengths that come in none, fills of the narrowest window that they come
    in (doubled until every length is covered or the window is a ``WINDOW``-th of the capacity)."""
    combos = combinations(capacity, lengths)
    window = 0
    while window < capacity // WINDOW:
        rare = np.zeros(capacity + 1, bool)
        rare[lengths] = True
        rare[combos] = False
        if not rare.any():
            break
        wider = min(max(1, 2 * window), capacity // WINDOW)
        combos = np.concatenate([combos, combinations(capacity, lengths, wider, window + 1, rare)])
        window = wider
    return combos


def nonnegative_counts(combos: np.ndarray, histogram: np.ndarray, weight: np.ndarray, rounds: int = 60, block: int = 48) -> np.ndarray:
    """x >= 0 minimising the weighted squared difference between A x and the histogram.

    Active-set method: each round frees the ``block`` columns of steepest descent, solves the free
    ones by their normal equations and steps back along the line where any would turn negative.
    The free set never exceeds the number of lengths by more than a block.
    """
    width, m = len(histogram), len(combos)
    x = np.zeros(m)
    if not m or not histogram.any():
        return x
    free = np.zeros(m, bool)
    w2 = weight**2

    def product(y: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(y)
        out = np.zeros(width)
        for j in range(combos.shape[1]):
            np.add.at(out, combos[used, j], y[used])
        out[0] = 0
        return out

    for _ in range(rounds):
        slack = w2 * (histogram - product(x))
        slack[0] = 0
        slope = slack[combos].sum(1)
        slope[free] = -np.inf
        best = np.argpartition(-slope, min(block, m) - 1)[:block]
        best = best[slope[best] > 1e-6 * max(1.0, float(np.abs(slack).max()))]
        if not len(best):
            break
        free[best] = True
        for _ in range(2 * width):
            f = np.flatnonzero(free)
            a = np.zeros((width, len(f)))
            for j in range(combos.shape[1]):
                np.add.at(a, (combos[f, j], np.arange(len(f))), 1.0)
            a[0] = 0
            a *= weight[:, None]
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-6 * (1 + gram.diagonal().max())
            z = np.linalg.solve(gram, a.T @ (weight * histogram))
            if (z > 0).all():
                x[f] = z
                break
            bad = z <= 0
            step = np.min(x[f][bad] / np.maximum(x[f][bad] - z[bad], 1e-12))
            x[f] = np.maximum(x[f] + min(1.0, step) * (z - x[f]), 0)
            gone = f[bad & (x[f] <= 1e-9)]
            x[gone] = 0
            free[gone] = False
    return x


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: (contents as length -> number, containers) patterns.

    Works on the histogram, so its cost depends on the capacity and not on the number of items.
    """
    room: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(histogram[length])
        space = length
        while left and space < capacity:
            if not room[space]:
                space += 1
                continue
            held, count = room[space].pop()
            per = min(space // length, left)
            use = min(count, left // per)
            if count > use:
                room[space].append((held, count - use))
            room[space - per * length].append((held | {length: per}, use))
            left -= per * use
            space = length
        per = capacity // length
        for each, count in ((per, left // per), (left % per, 1)):
            if each and count:
                room[capacity - each * length].append(({length: each}, count))
    return [p for space in sorted(room) for p in room[space]]


@dataclass
class Packing:
    """Where the r-th item of each length goes: slots in order of length, then pattern."""

    capacity: int
    first_slot: np.ndarray  # by length, number of slots for shorter lengths
    ends: np.ndarray  # by (length, pattern), global number of the slot after its last
    base: np.ndarray  # first container of the pattern
    per: np.ndarray  # items of this length in each of its containers
    containers: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        slot = self.first_slot[length] + rank
        k = np.searchsorted(self.ends, slot, side="right")
        start = np.where(k > 0, self.ends[np.maximum(k - 1, 0)], 0)
        return self.base[k] + (slot - start) // self.per[k]


def solved(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns by least squares: solve on the cells, round down, fill with real lengths, pack what
    is left by best fit.

    A cell holds the lengths around a multiple of capacity / ``GRID``. All but the last item of a
    combination are the longest lengths left in their cells; the last one is the longest that still
    fits, of whatever cell, so rounding to cells costs no room.
    """
    cells = min(GRID, capacity)
    lengths = np.arange(capacity + 1)
    cell = np.clip(np.rint(lengths * cells / capacity).astype(int), 1, cells)
    coarse = np.bincount(cell[1:], histogram[1:], cells + 1)
    combos = covering(cells, np.flatnonzero(coarse))
    x = nonnegative_counts(combos, coarse, np.sqrt(np.arange(cells + 1) / cells) + 0.1)
    remaining = histogram.astype(np.int64).copy()
    remaining[0] = 0
    alive = [int(v) for v in np.flatnonzero(remaining)]
    first = np.searchsorted(cell[1:], np.arange(cells + 2)) + 1  # lengths of cell g: first[g] .. first[g + 1] - 1
    slack = max(1, capacity // cells)
    patterns: list[tuple[dict[int, int], int]] = []

    def longest(upto: int, need: dict[int, int]) -> int:
        k = bisect_right(alive, upto) - 1
        while k >= 0 and remaining[alive[k]] <= need.get(alive[k], 0):
            k -= 1
        return alive[k] if k >= 0 else 0

    for k in np.argsort(-x, kind="stable"):
        count = int(np.floor(x[k] + 1e-9))
        if count < 1:
            break
        parts = combos[k][combos[k] > 0]
        waste = int((cells - parts.sum()) * capacity // cells) + slack
        while count > 0:
            need: dict[int, int] = {}
            room = capacity
            for g in parts[:-1]:
                real = longest(min(room, int(first[g + 1]) - 1), need)
                if real < first[g]:
                    break
                need[real] = need.get(real, 0) + 1
                room -= real
            else:
                real = longest(room, need)
                if real and room - real <= waste:
                    need[real] = need.get(real, 0) + 1
                    room -= real
            if sum(need.values()) < len(parts):
                break
            take = min([count, *(int(remaining[v]) // n for v, n in need.items())])
            for v, n in need.items():
                remaining[v] -= take * n
                if not remaining[v]:
                    del alive[bisect_left(alive, v)]
            patterns.append((need, take))
            count -= take
    return patterns + best_fit(remaining, capacity)


def plan_containers(histogram: np.ndarray, capacity: int) -> Packing:
    """Every item of the histogram has a slot: by least squares, or by best fit alone in the rare
    case that this takes fewer containers."""
    patterns = min(solved(histogram, capacity), best_fit(histogram.astype(np.int64), capacity), key=lambda p: sum(n for _, n in p))
    slots = defaultdict(list)
    base = 0
    for held, count in patterns:
        for length, per in held.items():
            slots[length].append((base, count, per))
        base += count
    first, ends, bases, pers, seen = np.zeros(capacity + 1, np.int64), [], [], [], 0
    for length in range(1, capacity + 1):
        first[length] = seen
        for b, count, per in slots.get(length, ()):
            seen += count * per
            ends.append(seen)
            bases.append(b)
            pers.append(per)
    as_long = lambda v: np.array(v or [0], np.int64)
    return Packing(capacity, first, as_long(ends), as_long(bases), np.maximum(as_long(pers), 1), base)


def sized_documents(documents: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens)``, one row per document; null or blank texts have 0 tokens.

    The whole text is measured where it is read; only the two numbers travel. Rows without an id
    take no part; of rows repeating one the longest text counts.
    """
    rows = documents.select(F.col(ident).alias("doc_id"), token_count(F.col(text)).alias("n_tokens"))
    return rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = 512) -> tuple[DataFrame, Packing]:
    """Assign every document to containers of ``capacity`` tokens.

    ``sizes`` has ``(doc_id, n_tokens)``. Returns ``(doc_id, piece, token_start, n_tokens,
    container)`` and the plan. A text over the capacity is cut after every ``capacity`` tokens: its
    full pieces fill a container each, the last one is packed with the other items. No other text
    is cut. Documents of 0 tokens take no room and have no row.

    The histogram that the driver solves has ``capacity`` bins whatever the number of documents;
    items are numbered inside their length by bucketed running totals, never by one task for one
    length.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    items = durable(
        sizes.where("n_tokens > 0").select(
            "doc_id", F.col("n_tokens").cast("long").alias("_all"),
            F.expr(f"n_tokens div {capacity}").alias("_full"), F.expr(f"cast(n_tokens % {capacity} as int)").alias("length"),
        ), "items")
    found = items.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(capacity + 1, np.int64)
    for row in found:
        histogram[row["length"]] = row["n"]
    plan = plan_containers(histogram, capacity)
    numbered = items.where("length > 0").withColumn("_h", F.xxhash64("doc_id")).withColumn("_bucket", hash_bucket(F.col("_h"), 64)).withColumn("_one", F.lit(1))
    ranked = running_total(numbered, ["length"], "_bucket", [F.col("_h"), F.col("doc_id")], "_one", "_rank")
    id_type = sizes.schema["doc_id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            place = plan.place(b["length"].to_numpy(np.int64), b["_rank"].to_numpy(np.int64) - 1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "piece": b["_full"], "token_start": b["_full"] * capacity, "n_tokens": b["length"].astype("int64"), "container": place})

    tails = ranked.select("doc_id", "_full", "length", "_rank").mapInPandas(assign, f"doc_id {id_type}, piece long, token_start long, n_tokens long, container long")
    whole = items.where("_full > 0").withColumn("_h", F.xxhash64("doc_id")).withColumn("_bucket", hash_bucket(F.col("_h"), 4096)).withColumn("_g", F.lit(0))
    fulls = running_total(whole, ["_g"], "_bucket", [F.col("_h"), F.col("doc_id")], "_full", "_upto")
    fulls = fulls.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)).alias("piece"), (F.col("_upto") - F.col("_full") + F.lit(plan.containers)).alias("_base"))
    fulls = fulls.select("doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.lit(capacity).cast("long").alias("n_tokens"), (F.col("_base") + F.col("piece")).alias("container"))
    return tails.unionByName(fulls), plan


def packing_report(assigned: DataFrame, capacity: int = 512) -> DataFrame:
    """One row: items, containers, tokens, the fullest container, containers over the capacity, the
    fewest containers possible, and the share of room used."""
    per = assigned.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = per.agg(zero(F.sum("items")).alias("n_items"), F.count("*").alias("n_containers"), zero(F.sum("used")).alias("n_tokens"), zero(F.max("used")).alias("fullest"), F.count_if(F.col("used") > capacity).alias("n_overfull"))
    return out.withColumn("fewest_possible", F.expr(f"(n_tokens + {capacity - 1}) div {capacity}")).withColumn("fill", F.round(F.col("n_tokens") / F.greatest(F.col("n_containers") * capacity, F.lit(1)), 4))
