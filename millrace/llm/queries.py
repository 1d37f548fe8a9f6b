"""The pN queries and, where SQL can express them, their equivalents for the correctness check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .common import table
from .contributors import cap_contributors, cap_report, fraction_cutoffs, keep_fraction, scored_records
from .mixing import mix, mix_report, shares, sourced_documents
from .neighbours import IndexParameters, all_neighbours, similar_pairs
from .packing import pack, packing_report, sized_documents
from .pairs import broken_pairs, fit_endings
from .readability import corpus_profile, fit_reading_model, reading_levels
from .sampling import stratified_sample
from .splitting import cut_kinds, split_items

CAP = 15
CAPACITY = 512


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(all_neighbours(table(spark, sf_dir, "chunk_embeddings"), IndexParameters(min_similarity=0.82)))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_neighbours(table(spark, sf_dir, "chunk_embeddings"), IndexParameters())


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = table(spark, sf_dir, "qa_triples")
    return broken_pairs(triples, fit_endings(triples))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir)


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir).groupBy("field", "defect").agg(F.count("*").alias("n_pairs"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_records(table(spark, sf_dir, "qa_conversations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_contributors(_records(spark, sf_dir), max_count=CAP)[1].select(F.col("ident").alias("id"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_report(_records(spark, sf_dir), CAP)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_kinds(split_items(table(spark, sf_dir, "kg_nodes"), with_text=False))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "kg_nodes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_fraction(durable(_records(spark, sf_dir), "records")).select(F.col("ident").alias("id"))


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraction_cutoffs(_records(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = stratified_sample(table(spark, sf_dir, "qa_triples"), table(spark, sf_dir, "sample_targets"))[1]
    return report.where("deficit > 0").select("question_type", "difficulty")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_sample(table(spark, sf_dir, "qa_triples"), table(spark, sf_dir, "sample_targets"))[0]


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_sample(table(spark, sf_dir, "qa_triples"), table(spark, sf_dir, "sample_targets"))[1]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sized_documents(table(spark, sf_dir, "documents")), CAPACITY)[0]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lie in more than one container."""
    return _packed(spark, sf_dir).groupBy("doc_id").agg((F.max("container") > F.min("container")).alias("_cut")).where("_cut").select("doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that any good packing has: nothing lost, nothing overfull, within a hundredth of the fewest."""
    near = F.col("n_containers") <= F.col("fewest_possible") * 1.01 + 1
    return packing_report(_packed(spark, sf_dir), CAPACITY).select("n_items", "n_tokens", "fullest", "n_overfull", "fewest_possible", near.alias("within_one_percent"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = durable(sourced_documents(table(spark, sf_dir, "documents")), "sourced")
    plan, budget = shares(docs, table(spark, sf_dir, "mix_targets"))
    mixed = mix(docs, plan, budget)
    return mixed, mix_report(mixed, plan, budget)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].where("short").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reading_levels(docs, fit_reading_model(docs))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "band")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_profile(_levels(spark, sf_dir))


_SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
_TRIM = rf"^[{_SPACE}]+|[{_SPACE}]+$"
_TOKENS = rf"coalesce(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^{_SPACE}\p{{L}}\p{{N}}_]')), 0)"
_RECORDS = rf"""records AS (
  SELECT DISTINCT id, metadata.quality_score AS score,
    lower(regexp_replace(regexp_extract(metadata.source_file, '[^/\\]*$'), '{_TRIM}', '', 'g')) AS contributor
  FROM qa_conversations
  WHERE metadata.source_file IS NOT NULL AND regexp_replace(metadata.source_file, '{_TRIM}', '', 'g') <> ''
    AND metadata.quality_score IS NOT NULL AND NOT isnan(metadata.quality_score))"""
_LABELS = rf"""rows AS (
  SELECT DISTINCT triple_id, coalesce(nullif(lower(regexp_replace(question_type, '{_TRIM}', '', 'g')), ''), 'unknown') AS question_type,
    coalesce(nullif(lower(regexp_replace(difficulty, '{_TRIM}', '', 'g')), ''), 'unknown') AS difficulty FROM qa_triples),
counts AS (SELECT question_type, difficulty, count(*) AS n_available FROM rows GROUP BY ALL),
plan AS (SELECT t.question_type, t.difficulty, t.target_permille::BIGINT AS target_permille, t.min_keep::BIGINT AS min_keep, coalesce(n_available, 0) AS n_available,
    greatest(t.min_keep, ((SELECT count(*) FROM rows) // 5) * t.target_permille // 1000)::BIGINT AS needed
  FROM sample_targets t LEFT JOIN counts USING (question_type, difficulty))"""
_digest = lambda key: f"('0x' || substr(md5({key}), 1, 15))::BIGINT"
_MIX = rf"""docs AS (SELECT doc_id, lower(regexp_replace(source, '{_TRIM}', '', 'g')) AS source, {_TOKENS}::BIGINT AS n_tokens FROM documents),
budget AS (SELECT (sum(n_tokens) // 2)::BIGINT AS b FROM docs),
goal AS (SELECT t.source, t.weight_permille::BIGINT AS w, t.max_repeat::BIGINT AS r, coalesce(sum(n_tokens), 0)::BIGINT AS available, ((SELECT b FROM budget) * t.weight_permille // 1000)::BIGINT AS target
  FROM mix_targets t LEFT JOIN docs USING (source) GROUP BY ALL),
passes AS (SELECT doc_id, source, n_tokens, w, available, unnest(range(0, r)) AS pass FROM docs JOIN goal USING (source) WHERE n_tokens > 0 AND w > 0),
timed AS (SELECT doc_id, source, pass, n_tokens, (sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY {_digest("'77:' || doc_id || ':' || pass")}, doc_id) + pass * available)::BIGINT / w AS finish FROM passes),
summed AS (SELECT *, (sum(n_tokens) OVER (ORDER BY finish, source, pass, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS n_upto FROM timed),
merged AS (SELECT * FROM summed WHERE n_upto <= (SELECT b FROM budget))"""
_READING = r"""parts AS (
  SELECT doc_id, text, len(regexp_extract_all(text, '\p{L}+')) AS words, len(regexp_extract_all(text, '\p{L}{7,}')) AS long_words,
    len(list_filter(string_split(regexp_replace(text, '[.!?]+([\s\p{Z}\x{1c}-\x{1f}\x{85}]|$)|[\n\r]', chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '\p{L}'))) AS sentences
  FROM documents),
scored AS (SELECT doc_id, words / sentences + 100.0 * long_words / words AS score FROM parts WHERE words >= 10)"""

SQL = {
    "p3_found": f"WITH {_RECORDS} SELECT id FROM records QUALIFY row_number() OVER (PARTITION BY contributor ORDER BY score DESC, id) > {CAP}",
    "p3_report": f"WITH {_RECORDS} SELECT contributor, count(*) AS n_records, least(count(*), {CAP}) AS n_kept, greatest(count(*) - {CAP}, 0) AS n_removed FROM records GROUP BY contributor",
    "p4_found": r"""SELECT chunk_id, CASE WHEN max(widest) > 3000 THEN 'forced' ELSE 'natural' END AS cut FROM (
      SELECT chunk_id, list_max(list_transform(string_split(regexp_replace(page_content, '([.!?])\s|[\n\r]', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s))) AS widest
      FROM kg_nodes WHERE length(page_content) > 3000) GROUP BY chunk_id""",
    "p5_found": f"""WITH {_RECORDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY contributor) AS n FROM records),
      cuts AS (SELECT contributor, score AS cutoff FROM ranked WHERE r = (2 * n + 4) // 5) SELECT id FROM records JOIN cuts USING (contributor) WHERE score >= cutoff""",
    "p5_cutoffs": f"""WITH {_RECORDS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY contributor) AS n FROM records),
      cuts AS (SELECT contributor, n, r, score AS cutoff FROM ranked WHERE r = (2 * n + 4) // 5)
      SELECT contributor, any_value(n) AS n_rows, any_value(r) AS n_target, any_value(cutoff) AS cutoff, count(*) AS n_kept FROM records JOIN cuts USING (contributor) WHERE score >= cutoff GROUP BY contributor""",
    "p6_found": f"WITH {_LABELS} SELECT question_type, difficulty FROM plan WHERE n_available < needed",
    "p6_report": f"WITH {_LABELS} SELECT *, greatest(needed - n_available, 0)::BIGINT AS deficit, least(needed, n_available)::BIGINT AS n_drawn FROM plan",
    "p6_sample": rf"""WITH {_LABELS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY question_type, difficulty ORDER BY {_digest("'20240601:' || triple_id")}, triple_id) AS r FROM rows)
      SELECT triple_id, r.question_type, r.difficulty FROM ranked r JOIN plan p USING (question_type, difficulty) WHERE r <= least(needed, p.n_available)""",
    "p7_report": f"""WITH sizes AS (SELECT {_TOKENS} AS n FROM documents), total AS (SELECT sum(n)::BIGINT AS n_tokens, sum((n + {CAPACITY - 1}) // {CAPACITY})::BIGINT AS n_items FROM sizes)
      SELECT n_items, n_tokens, {CAPACITY}::BIGINT AS fullest, 0::BIGINT AS n_overfull, (n_tokens + {CAPACITY - 1}) // {CAPACITY} AS fewest_possible, true AS within_one_percent FROM total""",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > {CAPACITY}",
    "p8_found": f"""WITH docs AS (SELECT lower(regexp_replace(source, '{_TRIM}', '', 'g')) AS source, {_TOKENS} AS n FROM documents)
      SELECT t.source FROM mix_targets t LEFT JOIN docs d USING (source) GROUP BY t.source, t.max_repeat, t.weight_permille
      HAVING coalesce(sum(n), 0) * t.max_repeat < ((SELECT sum(n) FROM docs) // 2) * t.weight_permille // 1000""",
    "p8_mix": f"WITH {_MIX} SELECT doc_id, source, pass, n_tokens, finish, n_upto FROM merged",
    "p8_report": f"""WITH {_MIX}, taken AS (SELECT source, sum(n_tokens)::BIGINT AS taken, count(*) AS n_records, max(pass) + 1 AS n_passes FROM merged GROUP BY source)
      SELECT source, g.w AS weight_permille, g.r AS max_repeat, g.available, g.target, coalesce(taken, 0)::BIGINT AS taken, coalesce(n_records, 0)::BIGINT AS n_records, coalesce(n_passes, 0)::BIGINT AS n_passes,
        round(1000.0 * coalesce(taken, 0) / (SELECT b FROM budget), 3) AS actual_permille, g.available * g.r < g.target AS short FROM goal g LEFT JOIN taken USING (source)""",
    "p9_found": f"WITH {_READING} SELECT doc_id, CASE WHEN score < 30 THEN 'easy' WHEN score < 55 THEN 'middle' ELSE 'hard' END AS band FROM scored",
}

NAMES = [n for n in list(globals()) if n[0] == "p" and n[1:2].isdigit()]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
