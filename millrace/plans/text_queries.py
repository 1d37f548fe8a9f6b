"""Queries on texts: sentences, tokens, chunks, hashes, labels, model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.model_output import parse_object
from ..operators import chunking, dedup
from .catalogue import register, table

_SENTS = r"""parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+|\n\n+', '\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 20) AS s FROM documents WHERE text IS NOT NULL),
sents AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM parts)"""
_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_CHUNKS = "one AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1)"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def chunks(spark, sf, *columns):
    """One row per chunk, the latest load. Only the columns named are read and shuffled; all of
    them, texts too, where none is."""
    rows = table(spark, sf, "chunks")
    names = list(columns) or [c for c in rows.columns if c not in ("chunk_id", "loaded_at")]
    best = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*names), "loaded_at").alias("_c"))
    return best.select("chunk_id", "_c.*")


@register("sentence_split", f"WITH {_SENTS} SELECT doc_id, sent_idx::INT AS sent_idx, sentence FROM sents")
def sentence_split(spark, sf):
    return chunking.sentences(table(spark, sf, "documents"), "doc_id", "text")


@register("sentence_stats", f"WITH {_SENTS} SELECT doc_id, count(*) AS n_sentences, max(length(sentence)) AS longest, sum(length(sentence))::BIGINT AS n_chars FROM sents GROUP BY doc_id")
def sentence_stats(spark, sf):
    s = chunking.sentences(table(spark, sf, "documents"), "doc_id", "text")
    size = F.length("sentence")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(size).cast("long").alias("longest"), F.sum(size).alias("n_chars"))


@register("token_counts", f"SELECT doc_id, len({_TOK.format('text')})::BIGINT AS n_tokens, len(list_distinct({_TOK.format('text')}))::BIGINT AS n_distinct FROM documents WHERE text IS NOT NULL")
def token_counts(spark, sf):
    t = T.tokenise(F.col("text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@register("key_terms", f"SELECT DISTINCT triple_id, array_to_string(list_filter({_TOK.format('question')}, lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t)), ' ') AS terms FROM qa_triples WHERE question IS NOT NULL")
def key_terms(spark, sf):
    rows = table(spark, sf, "qa_triples").where("question is not null").select("triple_id", "question").distinct()
    return rows.select("triple_id", F.array_join(T.key_terms(F.col("question")), " ").alias("terms"))


@register(
    "expanded_query",
    f"""SELECT DISTINCT triple_id, array_to_string(list_concat({_TOK.format('question')}, list_filter({_TOK.format('question')},
      lambda t: length(t) > 2 AND NOT list_contains([{_STOP}], t) AND regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+'))), ' ') AS tokens FROM qa_triples WHERE question IS NOT NULL""",
)
def expanded_query(spark, sf):
    rows = table(spark, sf, "qa_triples").where("question is not null").select("triple_id", "question").distinct()
    return rows.select("triple_id", F.array_join(T.expand_query(F.col("question")), " ").alias("tokens"))


@register("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@register("exact_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_dedup(spark, sf):
    return dedup.exact_duplicates(table(spark, sf, "documents"), "doc_id", "text")


@register("exact_dedup_classes", "SELECT doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS n_copies FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY sha256(text))")
def exact_dedup_classes(spark, sf):
    """One row per document with the smallest id among its exact copies."""
    return dedup.copy_classes(table(spark, sf, "documents"), "doc_id", "text")


_FOLD = _SENTS + r""", toks AS (SELECT doc_id, sent_idx, length(sentence)::INT AS len, list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+')) AS w FROM sents),
pairs AS (SELECT a.doc_id, a.sent_idx, a.len, b.len AS nxt, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE
    round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) END AS sim FROM toks a LEFT JOIN toks b ON a.doc_id = b.doc_id AND b.sent_idx = a.sent_idx + 1),
walk AS (
  SELECT doc_id, 0 AS i, 0 AS start, len AS size, 1 AS held, NULL::INT AS ea, NULL::INT AS eb FROM pairs WHERE sent_idx = 0
  UNION ALL
  SELECT w.doc_id, w.i + 1,
    CASE WHEN w.held = 1 AND p.sim < 0.1 AND w.size >= 200 THEN w.i + 1 WHEN (CASE WHEN w.held = 1 THEN w.size + 1 + p.nxt ELSE p.nxt END) > 3000 THEN w.i + 2 ELSE w.start END,
    CASE WHEN w.held = 1 AND p.sim < 0.1 AND w.size >= 200 THEN p.nxt WHEN (CASE WHEN w.held = 1 THEN w.size + 1 + p.nxt ELSE p.nxt END) > 3000 THEN 0 WHEN w.held = 1 THEN w.size + 1 + p.nxt ELSE p.nxt END,
    CASE WHEN w.held = 1 AND p.sim < 0.1 AND w.size >= 200 THEN 1 WHEN (CASE WHEN w.held = 1 THEN w.size + 1 + p.nxt ELSE p.nxt END) > 3000 THEN 0 ELSE 1 END,
    CASE WHEN (w.held = 1 AND p.sim < 0.1 AND w.size >= 200) OR (CASE WHEN w.held = 1 THEN w.size + 1 + p.nxt ELSE p.nxt END) > 3000 THEN w.start END,
    CASE WHEN w.held = 1 AND p.sim < 0.1 AND w.size >= 200 THEN w.i WHEN (CASE WHEN w.held = 1 THEN w.size + 1 + p.nxt ELSE p.nxt END) > 3000 THEN w.i + 1 END
  FROM walk w JOIN pairs p ON p.doc_id = w.doc_id AND p.sent_idx = w.i WHERE p.nxt IS NOT NULL),
ends AS (SELECT doc_id, ea AS a, eb AS b FROM walk WHERE ea IS NOT NULL UNION ALL
  SELECT doc_id, start, i FROM walk w WHERE held = 1 AND i = (SELECT max(sent_idx) FROM pairs p WHERE p.doc_id = w.doc_id)),
spans AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::INT AS doc_chunk_id, a, b FROM ends)"""
_SPAN_TEXT = """SELECT p.doc_id, doc_chunk_id, a::INT AS sentence_start, b::INT AS sentence_end, (b - a + 1)::INT AS num_sentences,
  length(array_to_string(p.s[(a + 1)::INT:(b + 1)::INT], ' '))::INT AS char_length, array_to_string(p.s[(a + 1)::INT:(b + 1)::INT], ' ') AS page_content FROM spans JOIN parts p USING (doc_id)"""


@register("chunk_documents", f"WITH RECURSIVE {_FOLD} {_SPAN_TEXT}")
def chunk_documents(spark, sf):
    return chunking.chunk_documents(table(spark, sf, "documents"), "doc_id", "text")


@register("chunk_sizes", f"WITH RECURSIVE {_FOLD}, made AS ({_SPAN_TEXT}) SELECT count(*) AS total_chunks, round(avg(char_length), 0) AS avg_chunk_size, min(char_length) AS min_chunk_size, max(char_length) AS max_chunk_size FROM made")
def chunk_sizes(spark, sf):
    return chunking.chunk_statistics(chunking.chunk_documents(table(spark, sf, "documents"), "doc_id", "text"))


@register(
    "global_chunk_ids",
    f"WITH RECURSIVE {_FOLD} SELECT doc_id, doc_chunk_id, row_number() OVER (ORDER BY doc_id, doc_chunk_id) - 1 AS chunk_id FROM spans",
)
def global_chunk_ids(spark, sf):
    made = chunking.chunk_documents(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "doc_chunk_id")
    return chunking.global_ids(made, "doc_id", "doc_chunk_id")


@register("chunk_statistics", f"WITH {_CHUNKS} SELECT count(*) AS total_chunks, round(avg(length(page_content)), 0) AS avg_chunk_size, min(length(page_content))::INT AS min_chunk_size, max(length(page_content))::INT AS max_chunk_size FROM one")
def chunk_statistics(spark, sf):
    return chunking.chunk_statistics(chunks(spark, sf, "page_content"))


@register("chunks_per_source", f"WITH {_CHUNKS} SELECT source_file, count(*) AS n_chunks FROM one GROUP BY source_file")
def chunks_per_source(spark, sf):
    return chunking.chunks_per_source(chunks(spark, sf, "source_file"))


@register(
    "heading_paths",
    r"""WITH lines AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)^#{1,6} [^\n]*') AS h FROM documents WHERE text LIKE '%#%'),
    heads AS (SELECT doc_id, unnest(h) AS h FROM lines)
    SELECT doc_id, count(*) AS n_headings, max(length(regexp_extract(h, '^#+')))::INT AS deepest, min(regexp_replace(h, '^#+ ', '')) AS first_heading FROM heads GROUP BY doc_id""",
)
def heading_paths(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").contains("#"))
    found = docs.select("doc_id", F.explode(chunking.markdown_headings(F.col("text"))).alias("h"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_headings"), F.max("h.heading_level").alias("deepest"), F.min("h.heading_text").alias("first_heading"))


_HEADS = r"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM lines),
placed AS (SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) - length(line) - 1)::BIGINT AS off FROM numbered),
heads AS (SELECT doc_id, off, regexp_replace(line, '^#+ ', '') AS title, length(regexp_extract(line, '^#+')) AS lvl FROM placed WHERE regexp_matches(line, '^#{1,6} '))"""


@register(
    "chunk_heading_context",
    f"""WITH RECURSIVE {_FOLD}, made AS ({_SPAN_TEXT}), {_HEADS},
    spots AS (SELECT doc_id, doc_chunk_id, strpos(text, substr(page_content, 1, 100)) - 1 AS spot FROM made JOIN documents USING (doc_id)),
    held AS (SELECT a.doc_id, a.doc_chunk_id, h.lvl, h.title FROM spots a JOIN heads h ON h.doc_id = a.doc_id AND a.spot >= 0 AND h.off <= a.spot
      WHERE NOT EXISTS (SELECT 1 FROM heads g WHERE g.doc_id = h.doc_id AND g.off > h.off AND g.off <= a.spot AND g.lvl <= h.lvl)),
    paths AS (SELECT doc_id, doc_chunk_id, array_to_string(list(title ORDER BY lvl), ' > ') AS heading_path, last(title ORDER BY lvl) AS parent_section FROM held GROUP BY ALL)
    SELECT doc_id, doc_chunk_id, heading_path, parent_section FROM made LEFT JOIN paths USING (doc_id, doc_chunk_id)""",
)
def chunk_heading_context(spark, sf):
    """Heading path of each chunk cut from documents with markdown headings."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").alias("raw_text"))
    made = chunking.chunk_documents(docs, "doc_id", "raw_text")
    out = chunking.heading_paths(made, docs.withColumn("headings", chunking.markdown_headings(F.col("raw_text"))), "doc_id")
    return out.select("doc_id", "doc_chunk_id", F.array_join("heading_path", " > ").alias("heading_path"), "parent_section")


@register(
    "question_filters",
    f"""SELECT DISTINCT triple_id, length(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) >= 10 AS long_enough, regexp_matches(lower(question), '{"|".join(T.SOURCE_PHRASES)}') AS leans_on_source,
      regexp_matches(lower(question), '{"|".join(T.SOURCE_PHRASES_MULTIHOP)}') AS leans_multihop, list_contains([{", ".join(f"'{q}'" for q in T.VAGUE_QUESTIONS)}], lower(regexp_replace(question, '^\\s+|\\s+$', '', 'g'))) AS vague FROM qa_triples WHERE question IS NOT NULL""",
)
def question_filters(spark, sf):
    q = F.col("question")
    rows = table(spark, sf, "qa_triples").where("question is not null").select("triple_id", "question").distinct()
    return rows.select("triple_id", T.long_enough(q, 10).alias("long_enough"), T.leans_on_source(q).alias("leans_on_source"), T.leans_on_source(q, True).alias("leans_multihop"), T.is_vague(q).alias("vague"))


@register(
    "word_overlap",
    """WITH w AS (SELECT DISTINCT triple_id, list_filter(list_distinct(string_split_regex(lower(question), '\\s+')), lambda x: x <> '') AS a, list_filter(list_distinct(string_split_regex(lower(coalesce(answer, '')), '\\s+')), lambda x: x <> '') AS b FROM qa_triples WHERE question IS NOT NULL)
    SELECT triple_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS overlap FROM w""",
)
def word_overlap(spark, sf):
    rows = table(spark, sf, "qa_triples").where("question is not null").select("triple_id", "question", "answer").distinct()
    return rows.select("triple_id", F.round(T.word_jaccard(F.col("question"), F.col("answer")), 6).alias("overlap"))


@register(
    "normalised_terms",
    """WITH one AS (SELECT DISTINCT chunk_id, entities, keyphrases FROM kg_nodes)
    SELECT chunk_id, array_to_string(list_sort(list_filter(list_distinct(list_transform(entities, lambda e: lower(trim(e)))), lambda e: e <> '')), '|') AS entities,
      array_to_string(list_filter(list_transform(keyphrases, lambda e: lower(trim(e))), lambda e: e <> ''), '|') AS keyphrases FROM one""",
)
def normalised_terms(spark, sf):
    rows = table(spark, sf, "kg_nodes").select("chunk_id", "entities", "keyphrases").distinct()
    return rows.select("chunk_id", F.array_join(F.array_sort(F.array_distinct(T.normalise_terms(F.col("entities")))), "|").alias("entities"), F.array_join(T.normalise_terms(F.col("keyphrases")), "|").alias("keyphrases"))


@register("parse_props", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def parse_props(spark, sf):
    return table(spark, sf, "events").select("event_id", parse_object(F.col("props"), "k int")["k"].alias("k"))


@register("previews", """SELECT DISTINCT triple_id, substr(question, 1, 100) AS question, CASE WHEN length(answer) > 120 THEN substr(answer, 1, 120) || '...' ELSE answer END AS answer,
  CASE WHEN quality_score >= 0.8 THEN 'good' WHEN quality_score >= 0.6 THEN 'warn' ELSE 'bad' END AS band FROM qa_triples WHERE quality_score IS NOT NULL AND NOT isnan(quality_score)""")  # fmt: skip
def previews(spark, sf):
    rows = table(spark, sf, "qa_triples").where("quality_score is not null and not isnan(quality_score)").select("triple_id", "question", "answer", "quality_score").distinct()
    return rows.select("triple_id", T.truncate(F.col("question"), 100).alias("question"), T.truncate(F.col("answer"), 120, "...").alias("answer"), T.score_band(F.col("quality_score")).alias("band"))


@register("answer_prompts", f"""WITH {_CHUNKS}, t AS (SELECT DISTINCT triple_id, question, source_chunk_id FROM qa_triples)
  SELECT triple_id, 'Q: ' || coalesce(question, '') || chr(10) || '[Source: ' || coalesce(source_file, 'unknown') || ']' || chr(10) || coalesce(substr(page_content, 1, 8000), '') AS prompt FROM t JOIN one ON chunk_id = source_chunk_id""")  # fmt: skip
def answer_prompts(spark, sf):
    rows = table(spark, sf, "qa_triples").select("triple_id", "question", F.col("source_chunk_id").alias("chunk_id")).distinct().join(chunks(spark, sf, "source_file", "page_content"), "chunk_id")
    context = T.source_context(F.array(F.struct("source_file", F.substring("page_content", 1, 8000).alias("page_content"))))
    return rows.select("triple_id", T.prompt("Q: {question}\n{context}", question=F.col("question"), context=context).alias("prompt"))


@register("human_sizes", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:,.1f}', n_chars / 1024) || ' KB' ELSE format('{:,.1f}', n_chars / 1048576) || ' MB' END AS size FROM documents")
def human_sizes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.human_bytes(F.col("n_chars")).alias("size"))


@register("parse_failures", "SELECT count(text) AS n_good, count(*) - count(text) AS n_failed FROM documents")
def parse_failures(spark, sf):
    """Documents without a text are failures that stop nothing else."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("text").isNull(), "no text").alias("error"))
    good, failed = chunking.split_failures(docs)
    return good.agg(F.count("*").alias("n_good")).crossJoin(failed.agg(F.count("*").alias("n_failed")))
