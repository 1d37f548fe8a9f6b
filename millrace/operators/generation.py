"""Stages that ask a model. Prompts and parsing are expressions; only the call leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model_output import QUESTION, SCORES_MULTIHOP, checked_scores, parse_items, parse_object, ratio, share_true, verdict_ratio
from ..functions.text import is_vague, leans_on_source, long_enough, normalise_terms, prompt, source_context, strip, truncate, word_jaccard
from ..session import durable
from .models import CallPolicy, ModelClient, completion
from .scoring import WEIGHTS_MULTIHOP

Factory = Callable[[], ModelClient]

# How much text a prompt holds, in characters.
LIMITS = {"questions": 4000, "properties": 3000, "bridge": 3000, "answer": 8000, "judge": 6000, "passage": 1000, "preview": 200, "source": 500}
MAX_QUESTIONS, MAX_PER_PAIR = 15, 3

# Prompts: fields that a client can read, in our own words.
ASK_QUESTIONS = "TASK: questions\nWrite at most {most} questions that this text answers, each with a follow-up, as a JSON array.\nMOST: {most}\nSCENARIO: {scenario}\nKIND: {kind}\nTEXT: {text}\n"
ASK_FILTER = "TASK: filter\nReturn the questions worth keeping, word for word, as a JSON array.\nQUESTIONS: {questions}\n"
ASK_PROPERTIES = "TASK: properties\nName entities, key phrases and topics as a JSON object.\nTEXT: {text}\n"
ASK_BRIDGE = "TASK: bridge\nWhich concepts do both texts share? JSON object with bridge_concepts and connection_type.\nA: {a}\nB: {b}\n"
ASK_MULTIHOP = "TASK: multihop\nWrite at most {most} questions that need both texts, as a JSON array.\nMOST: {most}\nCONCEPTS: {concepts}\nA: {a}\nB: {b}\n"
ASK_ANSWER = "TASK: answer\nAnswer from the context only, as a JSON object with answer and follow_up_a.\nQUESTION: {question}\nFOLLOW_UP: {follow_up}\nCONTEXT: {context}\n"
ASK_SCORE = "TASK: score\nScore the answer from 0 to 1 on each criterion, as a JSON object.\nQUESTION: {question}\nANSWER: {answer}\nCONTEXT: {context}\n"
ASK_CLAIMS = "TASK: claims\nList the claims of the answer as a JSON object.\nANSWER: {answer}\n"
ASK_VERIFY = "TASK: verify\nIs each claim supported by the context? JSON object with verdicts.\nCLAIMS: {claims}\nCONTEXT: {context}\n"
ASK_PRECISION = "TASK: precision\nIs each passage relevant? JSON object.\nQUESTION: {question}\nANSWER: {answer}\nCONTEXT: {context}\n"
ASK_RECALL = "TASK: recall\nHow many statements of the answer does the context hold? JSON object.\nANSWER: {answer}\nCONTEXT: {context}\n"
ASK_REVERSE = "TASK: reverse\nWhich questions does this answer? JSON object with questions.\nANSWER: {answer}\n"


def _call(df: DataFrame, ask: Column, factory: Factory, policy: CallPolicy, label: str) -> DataFrame:
    """``df`` with ``_out`` (text) and ``_error``, stored: a paid call is never evaluated twice."""
    return durable(df.withColumn("_r", completion(ask, factory, policy)).select("*", F.col("_r.text").alias("_out"), F.col("_r.error").alias("_error")).drop("_r"), label)


def single_hop_questions(chunks: DataFrame, factory: Factory, policy: CallPolicy = CallPolicy(), most: int = MAX_QUESTIONS) -> tuple[DataFrame, DataFrame]:
    """(questions, failures) from ``(chunk_id, page_content[, scenario, target_type])``.

    Chunks under 50 characters are not asked about. Of each answer at most ``most`` items are taken;
    those too short, leaning on the text or too vague are dropped.
    """
    rows = chunks.where(F.length("page_content") >= 50)
    scenario = F.col("scenario") if "scenario" in chunks.columns else F.lit("")
    kind = F.col("target_type") if "target_type" in chunks.columns else F.lit("")
    ask = prompt(ASK_QUESTIONS, most=F.lit(most), scenario=scenario, kind=kind, text=F.substring("page_content", 1, LIMITS["questions"]))
    done = _call(rows, ask, factory, policy, "questions")
    items = done.select("*", F.posexplode(F.slice(parse_items(F.col("_out"), QUESTION), 1, most)).alias("item_no", "_q"))
    q = strip(F.col("_q.question"))
    kept = items.where(long_enough(q, 10) & ~leans_on_source(q) & ~is_vague(q))
    fields = [c for c in ("persona", "query_style", "query_length") if c in chunks.columns]
    out = kept.select(F.col("chunk_id").alias("source_chunk_id"), "item_no", q.alias("question"), F.coalesce("_q.follow_up_q", F.lit("")).alias("follow_up_q"), "_q.question_type", "_q.difficulty", F.substring("page_content", 1, LIMITS["source"]).alias("source_chunk"), *fields)
    return out, done.where("_error is not null").select("chunk_id", F.col("_error").alias("error"))


def keep_by_verdict(questions: DataFrame, key: str, factory: Factory, policy: CallPolicy = CallPolicy(), batch: int = 30) -> DataFrame:
    """Drop the questions that a model does not return when asked which to keep.

    Questions are asked about in batches of ``batch`` by ``key`` (dense numbers); up to five in all
    are kept unasked. A batch without a readable verdict is kept whole. Comparison ignores case
    and white space at the ends.
    """
    if questions.limit(6).count() <= 5:
        return questions
    rows = questions.withColumn("_b", F.floor(F.col(key) / batch))
    packed = rows.groupBy("_b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "question"))), lambda x: x["question"]), "\n").alias("_qs"))
    done = _call(packed, prompt(ASK_FILTER, questions=F.col("_qs")), factory, policy, "filter")
    verdicts = done.select("_b", F.from_json(F.col("_out"), "array<string>").alias("_keep"))
    named = verdicts.select("_b", F.explode("_keep").alias("_k")).select("_b", F.lower(strip(F.col("_k"))).alias("_norm")).distinct()
    silent = verdicts.where("_keep is null").select("_b")
    judged = rows.withColumn("_norm", F.lower(strip(F.col("question"))))
    kept = judged.join(named, ["_b", "_norm"], "left_semi").unionByName(judged.join(silent, "_b", "left_semi"))
    return kept.drop("_b", "_norm")


def properties(chunks: DataFrame, factory: Factory, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Graph nodes: entities (case kept), key phrases and topics (lower case) of each chunk; empty
    for chunks under 50 characters and for unreadable output."""
    text = F.when(F.length("page_content") >= 50, F.substring("page_content", 1, LIMITS["properties"]))
    done = _call(chunks, F.when(text.isNotNull(), prompt(ASK_PROPERTIES, text=text)), factory, policy, "properties")
    got = parse_object(F.col("_out"), "entities array<string>, keyphrases array<string>, topics array<string>")
    done = done.withColumn("_g", got)
    pick = lambda n, low: F.coalesce(normalise_terms(F.col(f"_g.{n}"), low), F.array().cast("array<string>")).alias(n)
    return done.select("chunk_id", "source_file", pick("entities", False), pick("keyphrases", True), pick("topics", True), "parent_section", "heading_path", F.substring("page_content", 1, LIMITS["preview"]).alias("page_content"))


def multihop_questions(pairs: DataFrame, chunks: DataFrame, factory: Factory, policy: CallPolicy = CallPolicy(), most: int = MAX_PER_PAIR) -> tuple[DataFrame, DataFrame]:
    """(questions, pair records) for ``(source_id, target_id, strength)``.

    Pairs whose texts share no concept get none. Every bridged pair has a record, also when no
    question came of it.
    """
    text = chunks.select("chunk_id", F.substring("page_content", 1, LIMITS["bridge"]).alias("_t"))
    both = pairs.join(text.select(F.col("chunk_id").alias("source_id"), F.col("_t").alias("_a")), "source_id").join(text.select(F.col("chunk_id").alias("target_id"), F.col("_t").alias("_b")), "target_id")
    bridged = _call(both, prompt(ASK_BRIDGE, a=F.col("_a"), b=F.col("_b")), factory, policy, "bridges")
    found = parse_object(F.col("_out"), "bridge_concepts array<string>, connection_type string")
    bridged = bridged.withColumn("_g", found).where("_g is not null and size(_g.bridge_concepts) > 0 and lower(coalesce(_g.connection_type, '')) <> 'none'")
    bridged = bridged.select("source_id", "target_id", "strength", "_a", "_b", "_g.bridge_concepts", "_g.connection_type")
    done = _call(bridged, prompt(ASK_MULTIHOP, most=F.lit(most), concepts=F.array_join("bridge_concepts", ", "), a=F.col("_a"), b=F.col("_b")), factory, policy, "multihop")
    items = done.select("*", F.posexplode(F.slice(parse_items(F.col("_out"), QUESTION + ", reasoning_type string"), 1, most)).alias("item_no", "_q"))
    q = strip(F.col("_q.question"))
    kept = items.where(long_enough(q, 15) & ~leans_on_source(q, multihop=True))
    out = kept.select(
        F.col("source_id").alias("source_chunk_id"), F.array("source_id", "target_id").alias("source_chunk_ids"), "item_no", q.alias("question"), F.coalesce("_q.follow_up_q", F.lit("")).alias("follow_up_q"),
        F.lit("multihop").alias("question_type"), "_q.difficulty", "_q.reasoning_type", "bridge_concepts", "connection_type", F.lit(2).alias("hop_count"),
    )
    counts = out.groupBy("source_chunk_ids").agg(F.count("*").alias("questions_generated"))
    records = done.select("source_id", "target_id", F.col("strength").alias("similarity"), "bridge_concepts", "connection_type", F.array("source_id", "target_id").alias("source_chunk_ids")).join(counts, "source_chunk_ids", "left")
    return out, records.withColumn("questions_generated", F.coalesce("questions_generated", F.lit(0).cast("long"))).drop("source_chunk_ids")


def answers(questions: DataFrame, retrieved: DataFrame, key: str, factory: Factory, policy: CallPolicy = CallPolicy()) -> tuple[DataFrame, DataFrame]:
    """(answered triples, failures); all columns of the questions are carried along.

    ``retrieved`` comes from ``retrieval.package``. Answers under five characters are failures.
    """
    rows = questions.where(long_enough(F.col("question"), 1)).join(retrieved, key)
    rows = rows.withColumn("_ctx", F.substring(source_context(F.col("passages")), 1, LIMITS["answer"]))
    done = _call(rows, prompt(ASK_ANSWER, question=F.col("question"), follow_up=F.col("follow_up_q"), context=F.col("_ctx")), factory, policy, "answers")
    done = done.withColumn("_g", parse_object(F.col("_out"), "answer string, follow_up_a string"))
    good = long_enough(F.col("_g.answer"), 5)
    out = done.where(good).select(*questions.columns, "retrieved_chunk_ids", "retrieved_sources", "retrieval_scores", "retrieval_details", F.transform("passages", lambda p: p["page_content"]).alias("context"), strip(F.col("_g.answer")).alias("answer"), F.coalesce(strip(F.col("_g.follow_up_a")), F.lit("")).alias("follow_up_a"))
    return out, done.where(~good).select(key, F.coalesce("_error", F.lit("no answer")).alias("error"))


def judge(triples: DataFrame, factory: Factory, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Add ``validation_scores``; null where the output is unreadable or a score is out of range."""
    context = F.substring(F.array_join("context", "\n"), 1, LIMITS["judge"])
    done = _call(triples, prompt(ASK_SCORE, question=F.col("question"), answer=F.col("answer"), context=context), factory, policy, "scores")
    scores = checked_scores(parse_object(F.col("_out"), SCORES_MULTIHOP), list(WEIGHTS_MULTIHOP))
    return done.withColumn("validation_scores", scores).drop("_out", "_error")


def advanced_metrics(triples: DataFrame, factory: Factory, policy: CallPolicy = CallPolicy(), noise: DataFrame | None = None) -> DataFrame:
    """Add claim_faithfulness, context_precision, context_recall and answer_relevancy.

    With ``noise`` (``triple_id, noise_chunk``), also noise_sensitivity of those triples: 1 less the
    word overlap of the answer and the answer given with a distracting passage, and whether it
    changed (overlap under 0.7).
    """
    full = F.substring(F.array_join("context", "\n\n---\n\n"), 1, LIMITS["judge"])
    clipped = F.array_join(F.transform("context", lambda p: F.substring(p, 1, LIMITS["passage"])), "\n\n---\n\n")
    rows = triples.withColumn("_full", full)
    rows = _call(rows, prompt(ASK_CLAIMS, answer=F.col("answer")), factory, policy, "claims")
    rows = rows.withColumn("_claims", parse_object(F.col("_out"), "claims array<string>")["claims"]).drop("_out", "_error")
    rows = _call(rows, prompt(ASK_VERIFY, claims=F.array_join("_claims", "\n"), context=F.col("_full")), factory, policy, "verdicts")
    rows = rows.withColumn("claim_faithfulness", verdict_ratio(F.col("_claims"), parse_object(F.col("_out"), "verdicts array<string>")["verdicts"], "supported")).drop("_out", "_error")
    rows = _call(rows, prompt(ASK_PRECISION, question=F.col("question"), answer=F.col("answer"), context=clipped), factory, policy, "precision")
    rows = rows.withColumn("context_precision", share_true(parse_object(F.col("_out"), "relevant array<boolean>")["relevant"])).drop("_out", "_error")
    rows = _call(rows, prompt(ASK_RECALL, answer=F.col("answer"), context=F.col("_full")), factory, policy, "recall")
    got = parse_object(F.col("_out"), "total int, attributed int")
    rows = rows.withColumn("context_recall", ratio(got["attributed"], got["total"])).drop("_out", "_error")
    rows = _call(rows, prompt(ASK_REVERSE, answer=F.col("answer")), factory, policy, "reverse")
    asked = F.coalesce(parse_object(F.col("_out"), "questions array<string>")["questions"], F.array().cast("array<string>"))
    rows = rows.withColumn("answer_relevancy", relevancy(F.col("question"), asked)).drop("_out", "_error", "_full", "_claims")
    if noise is None:
        return rows
    mixed = rows.join(noise, "triple_id").withColumn("_noisy", F.concat(F.array_join("context", "\n\n---\n\n"), F.lit("\n\n---\n\n"), "noise_chunk"))
    mixed = _call(mixed, prompt(ASK_ANSWER, question=F.col("question"), follow_up=F.lit(""), context=F.substring("_noisy", 1, LIMITS["answer"])), factory, policy, "noise")
    again = parse_object(F.col("_out"), "answer string, follow_up_a string")["answer"]
    overlap = word_jaccard(F.col("answer"), again)
    measured = mixed.select("triple_id", F.round(1 - overlap, 3).alias("noise_sensitivity"), (overlap < 0.7).alias("answer_changed"))
    return rows.join(measured, "triple_id", "left")


def relevancy(question: Column, reverse: Column) -> Column:
    """Mean word overlap of a question with questions made from its answer, 3 decimals; 0 for none."""
    total = F.aggregate(reverse, F.lit(0.0), lambda s, q: s + word_jaccard(question, q))
    return F.when(F.size(reverse) > 0, F.round(total / F.greatest(F.size(reverse), F.lit(1)), 3)).otherwise(0.0)


def preview(text: Column, size: int = 100) -> Column:
    return truncate(text, size, "…")
