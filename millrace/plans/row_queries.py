"""Queries on answered questions: scores, acceptance, averages, samples, conversations, sheets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import title_label
from ..operators import reporting, scenarios, scoring
from ..session import shared_dir
from ..sources import sheets
from .catalogue import register, table

CRITERIA = ["faithfulness", "relevance", "completeness", "tone", "follow_up_quality"]
_ONE = "t AS (SELECT * FROM qa_triples QUALIFY row_number() OVER (PARTITION BY triple_id ORDER BY created_at DESC) = 1)"
_C = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END"
_S = _C("quality_score")
_W = lambda weights: " + ".join(f"coalesce({_C('validation_scores.' + n)}, 0) * {w}" for n, w in weights.items() if n in CRITERIA)
_LAB = lambda c: f"coalesce(nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), ''), 'unknown')"
_CROSS = "coalesce(len(list_distinct(retrieved_sources)) > 1, false)"


def triples(spark, sf, *columns):
    """One row per triple, the latest delivery. Only the columns named are read and shuffled; all of
    them, texts too, where none is."""
    rows = table(spark, sf, "qa_triples")
    names = list(columns) or [c for c in rows.columns if c not in ("triple_id", "created_at")]
    best = rows.groupBy("triple_id").agg(F.max_by(F.struct(*names), "created_at").alias("_t"))
    return best.select("triple_id", "_t.*")


@register(
    "overall_score",
    f"WITH {_ONE} SELECT triple_id, round(CASE WHEN lower(trim(coalesce(question_type, ''))) = 'multihop' THEN {_W(scoring.WEIGHTS_MULTIHOP)} ELSE {_W(scoring.WEIGHTS)} END, 6) AS overall FROM t",
)
def overall_score(spark, sf):
    score = scoring.overall_score(F.col("validation_scores"), F.col("question_type"), set(CRITERIA))
    return triples(spark, sf, "validation_scores", "question_type").select("triple_id", F.round(score, 6).alias("overall"))


@register("accept_reject", f"WITH {_ONE} SELECT triple_id, CASE WHEN coalesce({_S}, 0) >= 0.7 THEN 'accepted' WHEN coalesce({_S}, 0) >= 0.55 THEN 'borderline' ELSE 'rejected' END AS verdict FROM t")
def accept_reject(spark, sf):
    return triples(spark, sf, "quality_score").select("triple_id", scoring.verdict(F.col("quality_score")).alias("verdict"))


@register(
    "retried_scores",
    f"""WITH {_ONE}, r AS (SELECT triple_id, quality_score AS first, CASE WHEN coalesce({_S}, 0) >= 0.55 AND coalesce({_S}, 0) < 0.7 THEN round(({_W(scoring.WEIGHTS)}) + 0.05, 6) END AS again FROM t)
    SELECT triple_id, round(CASE WHEN again >= 0.7 THEN again ELSE {_C('first')} END, 6) AS quality_score FROM r""",
)
def retried_scores(spark, sf):
    """A second judgement (the weighted criteria and a little more) of borderline answers only."""
    t = triples(spark, sf, "quality_score", "validation_scores")
    border = t.where(scoring.verdict(F.col("quality_score")) == "borderline")
    again = border.select("triple_id", F.round(scoring.weighted(F.col("validation_scores"), scoring.WEIGHTS, set(CRITERIA)) + 0.05, 6).alias("quality_score"))
    out = scoring.apply_retries(t.select("triple_id", "quality_score"), again, "triple_id")
    return out.select("triple_id", F.round(scoring.clean(F.col("quality_score")), 6).alias("quality_score"))


@register("average_scores", f"WITH {_ONE} SELECT round(avg({_S}), 3) AS avg_first, round((sum({_S}) + sum(CASE WHEN {_S} >= 0.7 THEN {_S} END)) / (count({_S}) + count(CASE WHEN {_S} >= 0.7 THEN 1 END)), 3) AS avg_with_retries FROM t")
def average_scores(spark, sf):
    t = triples(spark, sf, "quality_score")
    return scoring.average_scores(t, t.where(scoring.verdict(F.col("quality_score")) == "accepted"))


@register("criteria_averages", f"WITH {_ONE}, l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS criterion, {_C('validation_scores.' + n)} AS s FROM t" for n in CRITERIA) + ") SELECT criterion, round(avg(s), 3) AS average, count(s) AS n FROM l WHERE s IS NOT NULL GROUP BY criterion")
def criteria_averages(spark, sf):
    return scoring.criteria_averages(triples(spark, sf, "validation_scores"), "validation_scores", CRITERIA)


@register(
    "quality_report",
    f"""WITH {_ONE} SELECT count(*) AS total_evaluated, count_if(coalesce({_S}, 0) >= 0.7)::BIGINT AS total_validated, count_if(coalesce({_S}, 0) < 0.7)::BIGINT AS total_rejected,
    count_if(coalesce({_S}, 0) >= 0.55 AND coalesce({_S}, 0) < 0.7)::BIGINT AS total_borderline, count_if({_S} IS NULL)::BIGINT AS failed_validation, round(avg({_S}), 3) AS avg_quality_score FROM t""",
)
def quality_report(spark, sf):
    return scoring.quality_report(triples(spark, sf, "quality_score"))


@register("metric_summary", f"WITH {_ONE} SELECT round(avg({_C('validation_scores.faithfulness')}), 3) AS avg_faithfulness, round(avg({_C('validation_scores.relevance')}), 3) AS avg_relevance, count(*) AS sample_size FROM t")
def metric_summary(spark, sf):
    return scoring.metric_summary(triples(spark, sf, "validation_scores").select("validation_scores.*"), ["faithfulness", "relevance"])


DIGEST = lambda seed, key: f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


@register("exact_sample", f"WITH {_ONE} SELECT triple_id FROM t QUALIFY row_number() OVER (ORDER BY {DIGEST(1, 'triple_id')}, triple_id) <= greatest(1, floor((SELECT count(*) FROM t) * 0.3))")
def exact_sample(spark, sf):
    """An exact 30 % sample drawn by digest."""
    return scoring.exact_sample(triples(spark, sf, "quality_score").select("triple_id"), "triple_id", 0.3)


@register("bernoulli_sample", f"WITH {_ONE} SELECT triple_id FROM t WHERE {DIGEST(1, 'triple_id')} % 1000000 < 100000")
def bernoulli_sample(spark, sf):
    return scoring.bernoulli_sample(triples(spark, sf), "triple_id").select("triple_id")


@register("type_histogram", f"WITH {_ONE} SELECT {_LAB('question_type')} AS question_type, {_LAB('difficulty')} AS difficulty, count(*) AS n FROM t GROUP BY 1, 2")
def type_histogram(spark, sf):
    return reporting.histogram(triples(spark, sf, "question_type", "difficulty"), "question_type", "difficulty")


@register(
    "scenario_assign",
    f"""WITH {_ONE}, pick AS (SELECT triple_id, ['{"','".join(scenarios.PERSONA_NAMES)}'][(triple_id % 5 + 1)::INT] AS persona, ['{"','".join(scenarios.STYLE_NAMES)}'][(triple_id % 3 + 1)::INT] AS query_style,
      ['{"','".join(scenarios.LENGTH_NAMES)}'][(triple_id % 3 + 1)::INT] AS query_length, (triple_id * 379) % 900 AS p FROM t)
    SELECT triple_id, persona, query_style, query_length, CASE WHEN p < 250 THEN 'factual' WHEN p < 450 THEN 'explanatory' WHEN p < 600 THEN 'procedural' WHEN p < 750 THEN 'comparative' WHEN p < 850 THEN 'inferential' ELSE 'scenario' END AS target_type FROM pick""",
)
def scenario_assign(spark, sf):
    return scenarios.scenarios(triples(spark, sf, "quality_score").select("triple_id"), "triple_id")


@register(
    "type_quota",
    "WITH s AS (SELECT source_file, count(DISTINCT chunk_id) AS n FROM chunks GROUP BY source_file), k AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{t}', {v})" for t, v in scenarios.TYPE_SHARES.items() if t != "multihop")
    + ") AS v(target_type, share)) SELECT source_file, target_type, greatest(1, round_even(n * share::DOUBLE, 0))::BIGINT AS n_questions FROM s, k",
)
def type_quota(spark, sf):
    """Pools of question types for the chunks of each file."""
    sizes = table(spark, sf, "chunks").groupBy("source_file").agg(F.countDistinct("chunk_id").alias("n"))
    return sizes.select("source_file", F.explode(scenarios.type_quota(F.col("n"))).alias("target_type")).groupBy("source_file", "target_type").agg(F.count("*").alias("n_questions"))


@register("distribution_text", "SELECT '- ~25% factual' || chr(10) || '- ~20% explanatory' || chr(10) || '- ~15% procedural' || chr(10) || '- ~15% comparative' || chr(10) || '- ~10% inferential' || chr(10) || '- ~5% scenario' AS text")
def distribution_text(spark, sf):
    return scenarios.distribution_text(spark)


# ---- conversations and sheets ----

_NO = "row_number() OVER (PARTITION BY run_id ORDER BY triple_id) - 1"
_TURNS = "CASE WHEN coalesce(follow_up_q, '') <> '' AND coalesce(follow_up_a, '') <> '' THEN 4 ELSE 2 END"


@register(
    "conversation_assembly",
    f"""WITH {_ONE} SELECT triple_id, substr(run_id, 1, 8) || '-' || ({_NO}) AS id, ({_TURNS})::INT AS n_messages, coalesce(answer, '') AS last_answer_first, coalesce(retrieved_sources[1], '') AS source_file, {_CROSS} AS cross_document FROM t WHERE run_id IS NOT NULL""",
)
def conversation_assembly(spark, sf):
    c = reporting.conversations(triples(spark, sf))
    return c.select("triple_id", "id", F.size("messages").alias("n_messages"), F.col("messages")[1]["content"].alias("last_answer_first"), F.col("metadata.source_file").alias("source_file"), F.col("metadata.cross_document").alias("cross_document"))


_MSG = "(SELECT id, metadata, unnest(messages) AS m, generate_subscripts(messages, 1) AS turn FROM (SELECT * FROM qa_conversations QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) = 1))"


def conversations(spark, sf):
    rows = table(spark, sf, "qa_conversations")
    best = rows.groupBy("id").agg(F.max_by(F.struct("messages", "metadata"), "recorded_at").alias("_c"))
    return best.select("id", "_c.*")


@register(
    "sheet_conversations",
    f"""SELECT id, turn::INT AS turn, m.role AS role, m.content AS content, CASE WHEN turn = 1 THEN round({_C('metadata.quality_score')}, 3) END AS quality_score,
    CASE WHEN turn = 1 THEN metadata.source_file END AS source_file, CASE WHEN turn = 1 AND metadata.cross_document THEN 'Yes' ELSE '' END AS cross_document FROM {_MSG}""",
)
def sheet_conversations(spark, sf):
    return reporting.conversation_sheet(conversations(spark, sf))


@register(
    "sheet_qa_pairs",
    f"""WITH {_ONE} SELECT row_number() OVER (ORDER BY triple_id) AS no, {", ".join(f"coalesce({c}, '') AS {c}" for c in ("question", "answer", "follow_up_q", "follow_up_a", "question_type", "difficulty"))},
    coalesce(array_to_string(retrieved_sources[1:2], ', '), '') AS source_files, round(coalesce({_S}, 0), 3) AS quality_score, {", ".join(f"round(coalesce({_C('validation_scores.' + n)}, 0), 3) AS {n}" for n in CRITERIA)} FROM t""",
)
def sheet_qa_pairs(spark, sf):
    return reporting.qa_sheet(triples(spark, sf))


@register("sheet_rejected", f"WITH {_ONE} SELECT triple_id, question, answer, round(coalesce({_S}, 0), 3) AS quality_score, CASE WHEN {_S} IS NULL THEN 'not scored' ELSE 'score ' || CASE WHEN coalesce({_S}, 0) >= 0.6 THEN 'warn' ELSE 'bad' END || ', under the threshold' END AS reason FROM t WHERE coalesce({_S}, 0) < 0.7")
def sheet_rejected(spark, sf):
    return reporting.rejected_sheet(triples(spark, sf))


_SUMMARY = f"""SELECT run_id, count(*) AS total_triples, count_if(coalesce({_S}, 0) >= 0.7)::BIGINT AS accepted, count_if(coalesce({_S}, 0) < 0.7)::BIGINT AS rejected,
  count_if({_LAB('question_type')} = 'multihop')::BIGINT AS multihop, count_if({_CROSS})::BIGINT AS cross_document, round(avg({_S}), 3) AS avg_quality_score FROM t GROUP BY run_id"""


@register("run_summary", f"WITH {_ONE} {_SUMMARY}")
def run_summary(spark, sf):
    return reporting.run_summary(triples(spark, sf, "run_id", "quality_score", "question_type", "retrieved_sources"))


@register(
    "sheet_summary",
    f"WITH {_ONE}, s AS ({_SUMMARY}) SELECT run_id, 'Total Triples' AS metric, total_triples::VARCHAR AS value FROM s UNION ALL SELECT run_id, 'Accepted', accepted::VARCHAR FROM s UNION ALL SELECT run_id, 'Rejected', rejected::VARCHAR FROM s UNION ALL SELECT run_id, 'Multihop', multihop::VARCHAR FROM s UNION ALL SELECT run_id, 'Cross Document', cross_document::VARCHAR FROM s",
)
def sheet_summary(spark, sf):
    return reporting.summary_sheet(reporting.run_summary(triples(spark, sf, "run_id", "quality_score", "question_type", "retrieved_sources")).drop("avg_quality_score"), "run_id")


@register(
    "export_json",
    """WITH one AS (SELECT * FROM qa_conversations QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_at DESC) = 1)
    SELECT id, array_to_string(list_transform(messages, lambda m: m.role || ': ' || m.content), chr(10)) AS said, metadata.source_file AS source_file, metadata.hop_count AS hop_count, coalesce(len(metadata.retrieval_details), -1)::INT AS n_details FROM one""",
)
def export_json(spark, sf):
    """Each conversation as one line of JSON, exported and read back."""
    rows = conversations(spark, sf)
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sheets.export_json(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return back.select("id", said.alias("said"), "metadata.source_file", "metadata.hop_count", F.coalesce(F.size("metadata.retrieval_details"), F.lit(-1)).alias("n_details"))


@register("export_sheet", f"WITH {_ONE}, s AS ({_SUMMARY}) SELECT run_id, metric, value FROM (UNPIVOT (SELECT run_id, total_triples, accepted, rejected FROM s) ON total_triples, accepted, rejected INTO NAME metric VALUE value)")
def export_sheet(spark, sf):
    """A sheet written as a folder of its own and read back."""
    per_run = reporting.run_summary(triples(spark, sf, "run_id", "quality_score", "question_type", "retrieved_sources")).select("run_id", "total_triples", "accepted", "rejected")
    path = sheets.export_sheets({"Run Summary": per_run}, f"{shared_dir(spark)}/sheets-{uuid.uuid4().hex}", "csv")[0]
    back = spark.read.schema(per_run.schema).option("header", "true").csv(path)
    return back.select("run_id", F.explode(F.create_map(*(x for c in ("total_triples", "accepted", "rejected") for x in (F.lit(c), F.col(c))))).alias("metric", "value"))


@register("scenario_texts", f"""WITH {_ONE}, p AS (SELECT triple_id, triple_id % 5 AS a, triple_id % 3 AS b, (triple_id * 379) % 900 AS p FROM t)
  SELECT triple_id, 'Asked by: ' || [{", ".join(f"'{x}'" for x in scenarios.PERSONAS.values())}][(a + 1)::INT] || chr(10) || 'Persona: ' || ['{"','".join(scenarios.PERSONA_NAMES)}'][(a + 1)::INT] || chr(10) || 'Style: ' || [{", ".join(f"'{x}'" for x in scenarios.STYLES.values())}][(b + 1)::INT] || chr(10)
    || 'Length: ' || [{", ".join(f"'{x}'" for x in scenarios.LENGTHS.values())}][(b + 1)::INT] || chr(10) || 'Kind: ' || CASE WHEN p < 250 THEN 'factual' WHEN p < 450 THEN 'explanatory' WHEN p < 600 THEN 'procedural' WHEN p < 750 THEN 'comparative' WHEN p < 850 THEN 'inferential' ELSE 'scenario' END AS text FROM p""")  # fmt: skip
def scenario_texts(spark, sf):
    """What a question writer is told."""
    rows = scenarios.scenarios(triples(spark, sf, "quality_score").select("triple_id"), "triple_id")
    return rows.select("triple_id", scenarios.instruction(F.col("persona"), F.col("query_style"), F.col("query_length"), F.col("target_type")).alias("text"))


@register("scenarios_allowed", f"WITH {_ONE} SELECT triple_id, ['expert', 'curious_student'][(triple_id % 2 + 1)::INT] AS persona, ['{"','".join(scenarios.STYLE_NAMES)}'][(triple_id % 3 + 1)::INT] AS query_style, 'long' AS query_length FROM t")
def scenarios_allowed(spark, sf):
    """Lists of wanted names: unknown ones are left out, a list without a known one allows all."""
    rows = scenarios.scenarios(triples(spark, sf, "quality_score").select("triple_id"), "triple_id", ["expert", "nobody", "curious_student"], ["unheard"], ["long"])
    return rows.drop("target_type")


@register("title_labels", f"WITH {_ONE} SELECT DISTINCT question_type, array_to_string(list_transform(string_split(replace(question_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM t WHERE question_type IS NOT NULL")
def title_labels(spark, sf):
    rows = table(spark, sf, "qa_triples").select("question_type").where("question_type is not null").distinct()
    return rows.select("question_type", title_label(F.col("question_type")).alias("label"))


@register("search_page", f"WITH {_ONE} SELECT triple_id, question FROM t WHERE lower(question) LIKE '%alarm%' OR lower(answer) LIKE '%alarm%' ORDER BY triple_id LIMIT 30 OFFSET 30")
def search_page(spark, sf):
    return reporting.search_page(triples(spark, sf), "Alarm", 1).select("triple_id", "question")
