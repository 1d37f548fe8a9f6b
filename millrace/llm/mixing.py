"""Problem 8: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import digest, running_total
from ..session import durable
from .common import strip, token_count

SEED = 77
#: Slices of virtual time in which the global order is sorted.
SLICES = 1024


def sourced_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens)``, one row per document, source trimmed and in lower case.

    Null and blank texts have 0 tokens; a null source stays null and matches no target. Rows
    without an id take no part; of rows repeating one the greatest (tokens, source) counts.
    """
    rows = documents.select("doc_id", F.lower(strip(F.col("source"))).alias("source"), token_count(F.col("text")).alias("n_tokens"))
    best = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("_b"))
    return best.select("doc_id", F.col("_b.source").alias("source"), F.col("_b.n_tokens").alias("n_tokens"))


@dataclass
class Share:
    source: str
    weight: int
    max_repeat: int
    available: int
    target: int

    @property
    def supply(self) -> int:
        return self.available * self.max_repeat


def shares(docs: DataFrame, targets: DataFrame, divisor: int = 2, max_sources: int = 100_000) -> tuple[list[Share], int]:
    """The rows of the table of targets with what is there, and the budget in tokens.

    The table of targets is small by nature and held by the driver (more than ``max_sources`` rows
    are refused). Weights are in thousandths; null weights and repeats read 0.
    """
    per = docs.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0).cast("long")).alias("n")).first()["n"]
    budget = total // divisor
    goal = targets.select(F.lower(strip(F.col("source"))).alias("source"), F.coalesce("weight_permille", F.lit(0)).cast("long").alias("w"), F.coalesce("max_repeat", F.lit(0)).cast("long").alias("r")).where("source is not null")
    goal = goal.groupBy("source").agg(F.sum("w").alias("w"), F.max("r").alias("r"))
    rows = goal.join(per, "source", "left").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    return [Share(r["source"], r["w"], r["r"], r["available"] or 0, budget * r["w"] // 1000) for r in sorted(rows, key=lambda r: r["source"])], budget


def closing_time(plan: list[Share], budget: int) -> float:
    """Virtual time at which the budget is spent: sum of min(weight x time, supply) = budget; when
    all sources run out before, the time at which the last one does."""
    live = sorted((s for s in plan if s.weight and s.supply), key=lambda s: s.supply / s.weight)
    spent, weight, end = 0, sum(s.weight for s in live), 0.0
    for s in live:
        end = s.supply / s.weight
        if spent + weight * end >= budget:
            return (budget - spent) / weight
        spent += s.supply
        weight -= s.weight
    return end


def mix(docs: DataFrame, plan: list[Share], budget: int) -> DataFrame:
    """The mixed sequence: ``(doc_id, source, pass, n_tokens, finish, n_upto)``.

    Each pass over a source takes its documents in an order of its own (a hash of id and pass). A
    document's virtual finish time is the source's tokens so far over its weight; the passes are
    merged by finish time and cut where the total would pass the budget (the first document that
    does not fit and all after it stay out). A source runs out after ``max_repeat`` passes; the
    others then fill the rest. Documents of 0 tokens take no part.

    Totals inside a source and along the global order are bucketed running totals: a source of a
    third of all rows is spread over its hash buckets, the global order over slices of time.
    """
    spark = docs.sparkSession
    live = [s for s in plan if s.weight and s.supply]
    # each source lags its fluid share by less than a document, so the budget is spent in documents
    # when the fluid shares exceed it by one for each source; what finishes later can't be reached
    longest = docs.agg(F.coalesce(F.max("n_tokens"), F.lit(0)).alias("m")).first()["m"]
    horizon = closing_time(plan, budget + (len(live) + 1) * longest) * (1 + 1e-9)
    rows = [(s.source, s.weight, s.available, min(s.max_repeat, int(s.weight * horizon // s.available) + 1)) for s in live]
    rule = spark.createDataFrame(rows, "source string, _w long, _available long, _passes long")
    every = docs.where("n_tokens > 0").join(F.broadcast(rule), "source").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)))
    every = durable(every.withColumn("_h", digest(SEED, F.col("doc_id"), F.col("pass"))).withColumn("_bucket", F.shiftright("_h", 52).cast("int")), "passes")
    own = running_total(every, ["source", "pass"], "_bucket", [F.col("_h"), F.col("doc_id")], "n_tokens", "_cum")
    timed = own.withColumn("finish", (F.col("_cum") + F.col("pass") * F.col("_available")) / F.col("_w"))
    timed = timed.where(F.col("finish") <= horizon).withColumn("_g", F.lit(0)).withColumn("_slice", F.floor(F.col("finish") / F.lit(max(horizon, 1e-9)) * SLICES).cast("int"))
    timed = durable(timed.select("doc_id", "source", "pass", "n_tokens", "finish", "_g", "_slice"), "timed")
    order = [F.col("finish"), F.col("source"), F.col("pass"), F.col("doc_id")]
    merged = running_total(timed, ["_g"], "_slice", order, "n_tokens", "n_upto")
    return merged.where(F.col("n_upto") <= budget).select("doc_id", "source", "pass", "n_tokens", "finish", "n_upto")


def mix_report(mixed: DataFrame, plan: list[Share], budget: int) -> DataFrame:
    """Per source of the targets: tokens there, wanted and taken, actual share, and whether short.

    ``short``, by the mixed rows: the source was taken to its last token in every pass allowed, and
    what was taken stays below its share of the budget.
    """
    spark = mixed.sparkSession
    rows = [(s.source, s.weight, s.max_repeat, s.available, s.target, s.supply) for s in plan]
    goal = spark.createDataFrame(rows, "source string, weight_permille long, max_repeat long, available long, target long, _supply long")
    taken = mixed.groupBy("source").agg(F.sum("n_tokens").alias("taken"), F.count("*").alias("n_records"), (F.max("pass") + 1).alias("n_passes"))
    out = F.broadcast(goal).join(taken, "source", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "n_records", "n_passes")]
    return out.select("source", "weight_permille", "max_repeat", "available", "target", *zero, F.round(1000.0 * F.coalesce("taken", F.lit(0)) / max(budget, 1), 3).alias("actual_permille"), ((F.coalesce("taken", F.lit(0)) >= F.col("_supply")) & (F.coalesce("taken", F.lit(0)) < F.col("target"))).alias("short"))
