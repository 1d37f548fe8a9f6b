"""Conversations, summaries, sheets, run and experiment analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import score_band, strip
from .ordering import numbered
from .scoring import clean


def label_or_unknown(c: Column) -> Column:
    text = F.lower(strip(c))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("unknown")).otherwise(text)


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    """Counts by labels; null and blank labels read ``unknown``."""
    named = df.select(*(label_or_unknown(F.col(c)).alias(c) for c in columns))
    return named.groupBy(*columns).agg(F.count("*").alias("n"))


def is_cross_document(sources: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(sources)) > 1, F.lit(False))


def messages(question: Column, answer: Column, follow_up_q: Column, follow_up_a: Column) -> Column:
    """Two turns, and two more iff both follow-ups are there and not empty."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    first = F.array(say("user", question), say("assistant", answer))
    both = (F.coalesce(follow_up_q, F.lit("")) != "") & (F.coalesce(follow_up_a, F.lit("")) != "")
    return F.when(both, F.concat(first, F.array(say("user", follow_up_q), say("assistant", follow_up_a)))).otherwise(first)


def conversations(triples: DataFrame) -> DataFrame:
    """``(id, messages, metadata)``; the id is the run's first 8 characters and the triple's number
    in the run by ``triple_id``, from 0. Runs of any size: numbers come from bucketed totals."""
    rows = numbered(triples.where("run_id is not null and triple_id is not null"), ["run_id"], "triple_id", "_no")
    keep = ["source_chunk_id", "question_type", "difficulty", "hop_count", "quality_score", "validation_scores", "retrieved_chunk_ids", "retrieved_sources", "retrieval_details"]
    meta = F.struct(*(F.col(k) for k in keep), F.coalesce(F.get("retrieved_sources", F.lit(0)), F.lit("")).alias("source_file"), is_cross_document(F.col("retrieved_sources")).alias("cross_document"))
    return rows.select(
        "run_id", "triple_id", F.concat(F.substring("run_id", 1, 8), F.lit("-"), F.col("_no")).alias("id"),
        messages(F.col("question"), F.col("answer"), F.col("follow_up_q"), F.col("follow_up_a")).alias("messages"), meta.alias("metadata"),
    )


def run_summary(triples: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per run: triples, accepted, rejected, multi-hop, cross-document and mean score."""
    s = clean(F.col("quality_score"))
    return triples.groupBy("run_id").agg(
        F.count("*").alias("total_triples"), F.count_if(F.coalesce(s, F.lit(0.0)) >= threshold).alias("accepted"), F.count_if(F.coalesce(s, F.lit(0.0)) < threshold).alias("rejected"),
        F.count_if(label_or_unknown(F.col("question_type")) == "multihop").alias("multihop"), F.count_if(is_cross_document(F.col("retrieved_sources"))).alias("cross_document"), F.round(F.avg(s), 3).alias("avg_quality_score"),
    )


# ---- sheets ----

def qa_sheet(triples: DataFrame, numbered_by: str = "triple_id") -> DataFrame:
    """Fourteen columns per answered question, numbered from 1 by ``numbered_by``."""
    rows = numbered(triples, [], numbered_by, "_no")
    show = lambda c: F.round(F.coalesce(clean(c), F.lit(0.0)), 3)
    names = ("faithfulness", "relevance", "completeness", "tone", "follow_up_quality")
    return rows.select(
        (F.col("_no") + 1).cast("long").alias("no"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer", "follow_up_q", "follow_up_a", "question_type", "difficulty")),
        F.coalesce(F.array_join(F.slice("retrieved_sources", 1, 2), ", "), F.lit("")).alias("source_files"), show(F.col("quality_score")).alias("quality_score"), *(show(F.col(f"validation_scores.{n}")).alias(n) for n in names),
    )


def conversation_sheet(convs: DataFrame) -> DataFrame:
    """One row per message, turns from 1; score, file and flag on the first turn only."""
    rows = convs.select("id", "metadata", F.posexplode("messages").alias("_p", "_m"))
    first = F.col("_p") == 0
    return rows.select(
        "id", (F.col("_p") + 1).alias("turn"), F.col("_m.role").alias("role"), F.col("_m.content").alias("content"),
        F.when(first, F.round(clean(F.col("metadata.quality_score")), 3)).alias("quality_score"), F.when(first, F.col("metadata.source_file")).alias("source_file"),
        F.when(first & F.col("metadata.cross_document"), "Yes").otherwise("").alias("cross_document"),
    )


def summary_sheet(summary: DataFrame, key: str) -> DataFrame:
    """``(key, metric, value)``: a one-row-per-key summary turned into lines of text."""
    names = [c for c in summary.columns if c != key]
    label = lambda c: c.replace("_", " ").title()
    pairs = F.explode(F.array(*(F.struct(F.lit(label(c)).alias("metric"), F.col(c).cast("string").alias("value")) for c in names)))
    return summary.select(key, pairs.alias("_e")).select(key, "_e.*")


def rejected_sheet(triples: DataFrame, threshold: float = 0.7) -> DataFrame:
    s = F.coalesce(clean(F.col("quality_score")), F.lit(0.0))
    reason = F.when(clean(F.col("quality_score")).isNull(), "not scored").otherwise(F.concat(F.lit("score "), score_band(s), F.lit(", under the threshold")))
    return triples.where(s < threshold).select("triple_id", "question", "answer", F.round(s, 3).alias("quality_score"), reason.alias("reason"))


# ---- calls ----

def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call from a table of prices per 1,000 tokens (``model, in_price, out_price``;
    the row of model ``default`` is for models without one). 6 decimals."""
    default = prices.where("model = 'default'").agg(F.max("in_price").alias("_di"), F.max("out_price").alias("_do"))
    named = prices.where("model <> 'default'")
    priced = calls.join(named, "model", "left").crossJoin(F.broadcast(default))
    cost = F.col("input_tokens") / 1000 * F.coalesce("in_price", "_di") + F.col("output_tokens") / 1000 * F.coalesce("out_price", "_do")
    return priced.withColumn("cost", F.round(cost, 6)).drop("in_price", "out_price", "_di", "_do")


def cost_rollup(costed: DataFrame) -> DataFrame:
    """Calls, tokens, cost and models by agent; the row of agent null holds the totals. Costs are
    summed as decimals, so their sum does not depend on the order of rows."""
    return costed.rollup("agent").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("cost").cast("decimal(24,6)")).cast("double").alias("cost"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
    )


# ---- runs and experiments ----

def recent(runs: DataFrame, at: str, key: str, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last(at), key).limit(n)


def live_runs(runs: DataFrame, now: Column, age_seconds: int = 3600) -> DataFrame:
    """Runs that are not both finished and older than ``age_seconds``."""
    done = label_or_unknown(F.col("status")).isin("completed", "failed")
    old = now.cast("double") - F.col("started_at").cast("timestamp").cast("double") > age_seconds
    return runs.where(~F.coalesce(done & old, F.lit(False)))


def dashboard(runs: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: runs, triples, and the mean of the scores that are not zero."""
    s = clean(F.col("quality_score"))
    return runs.agg(F.count("*").alias("n_runs")).crossJoin(triples.agg(F.count("*").alias("n_triples"), F.round(F.avg(F.when(s != 0, s)), 3).alias("mean_quality")))


def search_page(triples: DataFrame, needle: str, page: int = 0, size: int = 30) -> DataFrame:
    """A page of the triples whose question or answer contains the text, whatever its case."""
    low = needle.lower()
    hit = F.lower("question").contains(low) | F.lower("answer").contains(low)
    return triples.where(F.coalesce(hit, F.lit(False))).orderBy("triple_id").offset(page * size).limit(size)


def upsert(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The store with rows of ``fresh`` in place of those of the same key."""
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*store.columns))


def by_field(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, value, number)``: rows turned into fields; number is null for texts."""
    kinds = dict(df.dtypes)
    numeric = lambda f: kinds[f] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[f].startswith("decimal")
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), (F.col(f).cast("double") if numeric(f) else F.lit(None).cast("double")).alias("number")) for f in fields]
    return df.select(key, F.explode(F.array(*pairs)).alias("_e")).select(key, "_e.*")


def compare_experiments(fields: DataFrame, key: str, a: str, b: str, only_changed: bool = False) -> DataFrame:
    """``(field, value_a, value_b, delta)``: delta is b - a with 4 decimals where both are numbers."""
    pick = lambda k, s: fields.where(F.col(key) == k).select("field", F.col("value").alias(f"value_{s}"), F.col("number").alias(f"_{s}"))
    both = pick(a, "a").join(pick(b, "b"), "field", "full_outer")
    if only_changed:
        both = both.where(~F.col("value_a").eqNullSafe(F.col("value_b")))
    return both.select("field", "value_a", "value_b", F.round(F.col("_b") - F.col("_a"), 4).alias("delta"))


def phase_table(events: DataFrame) -> DataFrame:
    """Duration of each phase of each run from its events; all phases are kept."""
    ends = events.where("type = 'phase_complete'")
    lag = F.lag(F.col("ts").cast("double")).over(Window.partitionBy("run_id").orderBy("ts", "phase_number"))
    return ends.select("run_id", "phase", "phase_number", F.round(F.col("ts").cast("double") - lag, 2).alias("duration"))
