"""Queries on the stages that ask a model, with the deterministic offline client."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions import text as T
from ..functions.vectors import norm
from ..operators import generation, retrieval, scenarios, scoring
from ..operators.graph import ENTITY, KEYPHRASE, SECTION, multihop_pairs
from ..operators.models import OfflineModel, embedding, reuse_embeddings
from ..operators.ordering import numbered
from .catalogue import register, table
from .retrieval_queries import _BM25, _GRAPH, nodes, search_corpus
from .row_queries import _ONE, CRITERIA, DIGEST, triples
from .text_queries import _CHUNKS, chunks

_WORDS = r"list_filter(regexp_extract_all(lower(substr({0}, 1, {1})), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 4)"
_FIRST = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"


@register(
    "generated_questions",
    f"""WITH {_CHUNKS}, w AS (SELECT chunk_id, {_WORDS.format('page_content', 4000)} AS l FROM one WHERE length(page_content) >= 50), f AS (SELECT chunk_id, {_FIRST.format('l')}[1:15] AS l FROM w)
    SELECT chunk_id AS source_chunk_id, (i - 1)::INT AS item_no, 'What does the record say about ' || l[i] || '?' AS question, 'And how does ' || l[i] || ' change over time?' AS follow_up_q, ['simple', 'moderate', 'complex'][(i - 1) % 3 + 1] AS difficulty
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM f)""",
)
def generated_questions(spark, sf):
    """The questions of every chunk, with scenarios in the prompt."""
    rows = scenarios.scenarios(chunks(spark, sf), "chunk_id")
    rows = rows.withColumn("scenario", scenarios.instruction(F.col("persona"), F.col("query_style"), F.col("query_length"), F.col("target_type")))
    asked, _ = generation.single_hop_questions(rows, OfflineModel)
    return asked.select("source_chunk_id", "item_no", "question", "follow_up_q", "difficulty")


@register(
    "question_verdicts",
    """WITH q AS (SELECT DISTINCT triple_id, question FROM qa_triples WHERE question IS NOT NULL), n AS (SELECT *, (row_number() OVER (ORDER BY triple_id) - 1) // 30 AS b, lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) AS norm FROM q)
    SELECT triple_id FROM n WHERE EXISTS (SELECT 1 FROM n m WHERE m.b = n.b AND m.norm = n.norm AND length(m.question) > 15)""",
)
def question_verdicts(spark, sf):
    """Questions that the client returns when asked, in batches of thirty, which to keep."""
    rows = numbered(triples(spark, sf).where("question is not null").select("triple_id", "question"), [], "triple_id", "qa_idx")
    return generation.keep_by_verdict(rows, "qa_idx", OfflineModel).select("triple_id")


@register(
    "extracted_properties",
    f"""WITH {_CHUNKS}, w AS (SELECT chunk_id, CASE WHEN length(page_content) >= 50 THEN {_WORDS.format('page_content', 3000)} ELSE [] END AS l FROM one), f AS (SELECT chunk_id, {_FIRST.format('l')} AS l FROM w)
    SELECT chunk_id, coalesce(array_to_string(l[1:6], '|'), '') AS entities, coalesce(array_to_string(l[7:14], '|'), '') AS keyphrases, coalesce(array_to_string(l[1:2], '|'), '') AS topics FROM f""",
)
def extracted_properties(spark, sf):
    got = generation.properties(chunks(spark, sf), OfflineModel)
    return got.select("chunk_id", F.lower(F.array_join("entities", "|")).alias("entities"), F.array_join("keyphrases", "|").alias("keyphrases"), F.array_join("topics", "|").alias("topics"))


# The offline client in SQL: a field of a prompt ends where a line begins like another field.
_FIELD = r"trim(regexp_replace({0}, '\n[A-Z_]+: (?s:.*)$', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LONG = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 4)"
_PARTS = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 20)"
_WORDSET = r"list_distinct(list_filter(string_split_regex(lower({0}), '\s+'), lambda w: w <> ''))"
_OVERLAP = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_BRIDGED = f"""WITH {_GRAPH}, {_CHUNKS}, named AS (SELECT e.*, a.source_file IS DISTINCT FROM b.source_file AS cross_document, list_position(['{ENTITY}', '{KEYPHRASE}', '{SECTION}'], relationship_type) AS k
    FROM edges e JOIN nodes a ON a.chunk_id = source_id JOIN nodes b ON b.chunk_id = target_id WHERE strength BETWEEN 0.4 AND 0.82),
  best AS (SELECT source_id, target_id, arg_min(strength, k) AS strength, any_value(cross_document) AS cross_document FROM named GROUP BY ALL ORDER BY cross_document DESC, source_id, target_id LIMIT 50),
  pairs AS (SELECT source_id, target_id, strength, {_LONG.format(_FIELD.format("coalesce(substr(a.page_content, 1, 3000), '')"))} AS wa, {_LONG.format(_FIELD.format("coalesce(substr(b.page_content, 1, 3000), '')"))} AS wb
    FROM best JOIN one a ON a.chunk_id = source_id JOIN one b ON b.chunk_id = target_id),
  bridged AS (SELECT source_id, target_id, strength, list_filter({_FIRST.format("wa")}, lambda w: list_contains(wb, w))[1:5] AS concepts FROM pairs),
  asked AS (SELECT source_id, target_id, concepts[i] AS w, (i - 1)::INT AS item_no FROM (SELECT *, unnest(range(1, least(len(concepts), 3) + 1)) AS i FROM bridged))"""


@register("multihop_questions", f"{_BRIDGED} SELECT source_id AS id_a, target_id AS id_b, item_no, 'How does ' || w || ' link both records?' AS question, 2::INT AS hop_count FROM asked")
def multihop_questions(spark, sf):
    asked, _ = generation.multihop_questions(multihop_pairs(nodes(spark, sf), distinct_pairs=True), chunks(spark, sf), OfflineModel)
    return asked.select(F.col("source_chunk_ids")[0].alias("id_a"), F.col("source_chunk_ids")[1].alias("id_b"), "item_no", "question", "hop_count")


@register("multihop_records", f"""{_BRIDGED} SELECT source_id, target_id, strength AS similarity, array_to_string(concepts, ', ') AS bridge_concepts, 'shared_concept' AS connection_type, least(len(concepts), 3)::BIGINT AS questions_generated FROM bridged WHERE len(concepts) > 0""")
def multihop_records(spark, sf):
    records = generation.multihop_questions(multihop_pairs(nodes(spark, sf), distinct_pairs=True), chunks(spark, sf), OfflineModel)[1]
    return records.withColumn("bridge_concepts", F.array_join("bridge_concepts", ", "))


_RETRIEVED = rf"""q AS (SELECT DISTINCT triple_id AS qid, question FROM qa_triples WHERE question IS NOT NULL AND triple_id % 20 = 0), tq AS (SELECT qid, regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+') AS t FROM q),
  asked AS (SELECT qid, u AS term, count(*) AS qtf FROM (SELECT qid, unnest(list_concat(t, list_filter(t, lambda x: length(x) > 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.STOP_WORDS)}], x) AND regexp_full_match(x, '[\p{{L}}\p{{N}}]+')))) AS u FROM tq) GROUP BY qid, u),
  {_BM25}, top AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(0.4 / (60 + sparse_rank), 6) DESC, chunk_id) AS rank FROM sparse QUALIFY rank <= 5),
  ctx AS (SELECT qid, string_agg('[Source: ' || coalesce(source_file, 'unknown') || ']' || chr(10) || coalesce(page_content, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c FROM top JOIN docs USING (chunk_id) GROUP BY qid)"""
_ANSWERED = lambda asked, context: f"""list_sort(list_transform({_PARTS.format(context)}, lambda s: {{'n': -len(list_intersect(list_distinct({_LONG.format("s")}), {asked})), 's': s}}))"""


@register(
    "generated_answers",
    f"""WITH {_RETRIEVED}, best AS (SELECT qid, {_ANSWERED("w", "c")} AS r FROM (SELECT qid, list_distinct({_LONG.format(_FIELD.format("question"))}) AS w, {_FIELD.format("substr(c, 1, 8000)")} AS c FROM ctx JOIN q USING (qid) WHERE length(trim(question)) > 0))
    SELECT qid, r[1].s AS answer, coalesce(r[2].s, '') AS follow_up_a FROM best WHERE len(r) > 0""",
)
def generated_answers(spark, sf):
    """Every twentieth question answered from its passages; the dense side is down, so the inverted
    lists alone find them."""
    asked = table(spark, sf, "qa_triples").where("question is not null and triple_id % 20 = 0").select(F.col("triple_id").alias("qid"), "question").distinct()
    corpus = search_corpus(spark, sf)
    ranks = retrieval.bm25_ranks(asked.select("qid", T.expand_query(F.col("question")).alias("tokens")), corpus, "qid", "chunk_id")
    nothing = spark.createDataFrame([], "qid long, chunk_id int, dense_rank int")
    fused = retrieval.fuse(nothing, ranks, "qid", "chunk_id")
    found = retrieval.package(fused, corpus, "qid", "chunk_id")
    return generation.answers(asked.withColumn("follow_up_q", F.lit("")), found, "qid", OfflineModel)[0].select("qid", "answer", "follow_up_a")


def _in_context(spark, sf):
    """Answered questions with the text of their source chunk as context."""
    t = triples(spark, sf).where("answer is not null").select("triple_id", "question", "answer", "question_type", F.col("source_chunk_id").alias("chunk_id"))
    return t.join(chunks(spark, sf).select("chunk_id", F.array("page_content").alias("context")), "chunk_id")


_CONTEXT = f"""{_ONE}, {_CHUNKS}, ctx AS (SELECT triple_id, question, answer, question_type, coalesce(page_content, '') AS body, {_FIELD.format("answer")} AS a, {_FIELD.format("coalesce(question, '')")} AS q, {_FIELD.format("coalesce(substr(page_content, 1, 6000), '')")} AS c
  FROM t JOIN one ON chunk_id = source_chunk_id WHERE answer IS NOT NULL)"""


@register(
    "rubric_scores",
    f"""WITH {_CONTEXT}, w AS (SELECT triple_id, question_type, list_distinct({_LONG.format("a")}) AS a, list_distinct({_LONG.format("q")}) AS q, list_distinct({_LONG.format("c")}) AS c FROM ctx),
    s AS (SELECT triple_id, question_type, round_even(CASE WHEN len(a) > 0 THEN len(list_intersect(a, c)) / len(a) ELSE 0.0 END, 3) AS faithfulness,
      round_even(CASE WHEN len(q) > 0 THEN least(1.0, 0.5 + len(list_intersect(a, q)) / (2 * len(q))) ELSE 0.5 END, 3) AS relevance, round_even(least(1.0, len(a) / 10), 3) AS completeness, 0.9::DOUBLE AS tone, 0.8::DOUBLE AS follow_up_quality FROM w)
    SELECT triple_id, round(CASE WHEN lower(trim(coalesce(question_type, ''))) = 'multihop' THEN faithfulness * 0.25 + relevance * 0.2 + completeness * 0.15 + tone * 0.1 + follow_up_quality * 0.1 + 0.7 * 0.2
      ELSE faithfulness * 0.3 + relevance * 0.25 + completeness * 0.2 + tone * 0.15 + follow_up_quality * 0.1 END, 6) AS overall, faithfulness, relevance, completeness, tone, follow_up_quality FROM s""",
)
def rubric_scores(spark, sf):
    judged = generation.judge(_in_context(spark, sf), OfflineModel)
    score = scoring.overall_score(F.col("validation_scores"), F.col("question_type"), set(scoring.WEIGHTS_MULTIHOP))
    return judged.select("triple_id", F.round(score, 6).alias("overall"), *(F.col(f"validation_scores.{c}").alias(c) for c in CRITERIA))


_SUBSET = f"len(list_filter(list_distinct({_LONG.format('s')}), lambda w: NOT list_contains(cw, w))) = 0"


@register(
    "advanced_metrics",
    f"""WITH {_CONTEXT}, chosen AS (SELECT * FROM ctx QUALIFY row_number() OVER (ORDER BY {DIGEST(1, 'triple_id')}, triple_id) <= greatest(1, floor((SELECT count(*) FROM ctx) * 0.3))),
    w AS (SELECT *, {_PARTS.format("a")} AS said, list_distinct({_LONG.format("c")}) AS cw, list_distinct({_LONG.format("q")}) AS qw, {_FIRST.format(_LONG.format("a"))}[1:3] AS rw, {_WORDSET.format("coalesce(question, '')")} AS qs, {_WORDSET.format("answer")} AS aset FROM chosen),
    noise AS (SELECT arg_max(page_content, chunk_id) AS extra FROM one),
    noisy AS (SELECT triple_id, aset, {_ANSWERED("qw", _FIELD.format("substr(body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || extra, 1, 8000)"))}[1].s AS again FROM w, noise WHERE {DIGEST(2, 'triple_id')} % 1000000 < 100000),
    changed AS (SELECT triple_id, {_OVERLAP.format("aset", _WORDSET.format("coalesce(again, '')"))} AS o FROM noisy)
    SELECT triple_id, CASE WHEN len(said) = 0 THEN 1.0 ELSE round(len(list_filter(said, lambda s: {_SUBSET})) / len(said), 3) END AS claim_faithfulness,
      CASE WHEN len(list_intersect(qw, list_distinct({_LONG.format(_FIELD.format("substr(body, 1, 1000)"))}))) > 0 THEN 1.0 ELSE 0.0 END AS context_precision,
      CASE WHEN len(said) = 0 THEN 0.0 ELSE round(len(list_filter(said, lambda s: {_SUBSET})) / len(said), 3) END AS context_recall,
      CASE WHEN len(rw) = 0 THEN 0.0 ELSE round(list_sum(list_transform(rw, lambda r: {_OVERLAP.format("qs", "list_distinct(['what', 'does', 'the', 'record', 'say', 'about', r || '?'])")})) / len(rw), 3) END AS answer_relevancy,
      round(1 - o, 3) AS noise_sensitivity, coalesce(o < 0.7, false) AS answer_changed FROM w LEFT JOIN changed USING (triple_id)""",
)
def advanced_metrics(spark, sf):
    """Claims, precision, recall and relevancy of the pipeline's exact share, noise for its rate of these."""
    c = PipelineConfig()
    chosen = scoring.exact_sample(_in_context(spark, sf), "triple_id", c.metric_sample_share)
    other = chunks(spark, sf).agg(F.max_by("page_content", "chunk_id").alias("noise_chunk"))
    noisy = scoring.bernoulli_sample(chosen, "triple_id", c.noise_sample_rate, seed=2).select("triple_id").crossJoin(F.broadcast(other))
    out = generation.advanced_metrics(chosen, OfflineModel, noise=noisy)
    return out.select("triple_id", "claim_faithfulness", "context_precision", "context_recall", "answer_relevancy", "noise_sensitivity", F.coalesce(F.col("answer_changed").cast("boolean"), F.lit(False)).alias("answer_changed"))


@register("embeddings_reused", "SELECT DISTINCT triple_id, CASE WHEN triple_id % 2 = 0 THEN 1 ELSE 64 END::INT AS dimension FROM qa_triples WHERE question IS NOT NULL")
def embeddings_reused(spark, sf):
    """Questions that have a vector keep it; only the others are sent."""
    rows = table(spark, sf, "qa_triples").where("question is not null").select("triple_id", "question").distinct()
    rows = rows.withColumn("_v", F.when(F.col("triple_id") % 2 == 0, F.array(F.lit(1.0))))
    return reuse_embeddings(rows, "question", "_v", OfflineModel).select("triple_id", F.size("_v").alias("dimension"))


@register("embedded_sections", "SELECT DISTINCT parent_section AS section, 64 AS dimension, true AS some FROM chunks WHERE parent_section IS NOT NULL")
def embedded_sections(spark, sf):
    rows = table(spark, sf, "chunks").where("parent_section is not null").select(F.col("parent_section").alias("section")).distinct()
    rows = rows.withColumn("_v", embedding(F.col("section"), OfflineModel))
    return rows.select("section", F.size("_v").alias("dimension"), (norm(F.col("_v")) > 0).alias("some"))


@register(
    "answer_relevancy",
    r"""WITH q AS (SELECT DISTINCT triple_id, question, follow_up_q FROM qa_triples WHERE question IS NOT NULL),
    w AS (SELECT triple_id, list_filter(list_distinct(string_split_regex(lower(question), '\s+')), lambda x: x <> '') AS a, list_filter(list_distinct(string_split_regex(lower(coalesce(follow_up_q, '')), '\s+')), lambda x: x <> '') AS b FROM q)
    SELECT triple_id, round((CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END + CASE WHEN len(a) = 0 THEN 0.0 ELSE 1.0 END) / 2, 3) AS relevancy FROM w""",
)
def answer_relevancy(spark, sf):
    """Mean overlap of a question with its follow-up and with itself."""
    rows = table(spark, sf, "qa_triples").where("question is not null").select("triple_id", "question", "follow_up_q").distinct()
    return rows.select("triple_id", generation.relevancy(F.col("question"), F.array("follow_up_q", "question")).alias("relevancy"))


@register(
    "model_prompts",
    f"WITH {_CHUNKS} SELECT chunk_id, length('TASK: properties' || chr(10) || 'Name entities, key phrases and topics as a JSON object.' || chr(10) || 'TEXT: ' || coalesce(substr(page_content, 1, 3000), '') || chr(10))::INT AS size FROM one",
)
def model_prompts(spark, sf):
    ask = T.prompt(generation.ASK_PROPERTIES, text=F.substring("page_content", 1, generation.LIMITS["properties"]))
    return chunks(spark, sf).select("chunk_id", F.length(ask).alias("size"))
