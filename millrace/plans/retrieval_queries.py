"""Queries on vectors, inverted lists, fusion, duplicates and the graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import dedup, graph, retrieval
from ..session import shared_dir
from .catalogue import register, table
from .text_queries import chunks

_DOT = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[]) / sqrt(list_dot_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[]) * list_dot_product({1}.embedding::DOUBLE[], {1}.embedding::DOUBLE[]))"
_NEAR = f"""near AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round({_DOT.format('a', 'b')}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM near)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@register("knn_top5", f"WITH {_NEAR} SELECT query_id, item_id, similarity, rank::INT AS rank FROM ranked WHERE rank <= 5 AND query_id % 20 = 0")
def knn_top5(spark, sf):
    """Every twentieth vector is a query, all are searched."""
    v = vectors(spark, sf)
    return V.exact_top_k(v.where("id % 20 = 0"), v, 5, same=True)


@register("band_pairs", f"WITH {_NEAR} SELECT DISTINCT least(query_id, item_id) AS id_a, greatest(query_id, item_id) AS id_b, similarity FROM ranked WHERE rank <= 19 AND similarity BETWEEN 0.4 AND 0.82")
def band_pairs(spark, sf):
    v = vectors(spark, sf)
    return V.band_pairs(V.exact_top_k(v, v, 19, same=True))


@register("band_pairs_top50", f"WITH {_NEAR}, p AS (SELECT DISTINCT least(query_id, item_id) AS id_a, greatest(query_id, item_id) AS id_b, similarity FROM ranked WHERE rank <= 19 AND similarity BETWEEN 0.4 AND 0.82) SELECT p.*, x.label <> y.label AS cross_group FROM p JOIN embeddings x ON x.vec_id = id_a JOIN embeddings y ON y.vec_id = id_b ORDER BY (x.label <> y.label) DESC, similarity DESC, id_a, id_b LIMIT 50")
def band_pairs_top50(spark, sf):
    v = vectors(spark, sf)
    group = table(spark, sf, "embeddings").select("vec_id", "label")
    pairs = V.band_pairs(V.exact_top_k(v, v, 19, same=True)).join(group.toDF("id_a", "_x"), "id_a").join(group.toDF("id_b", "_y"), "id_b")
    pairs = pairs.select("id_a", "id_b", "similarity", (F.col("_x") != F.col("_y")).alias("cross_group"))
    return pairs.orderBy(F.desc("cross_group"), F.desc("similarity"), "id_a", "id_b").limit(50)


# The SQL of these queries ranks nine neighbours, as the original pipeline does: its mode, by name.
_EDGES = f"""{_NEAR}, edges AS (SELECT query_id AS src, item_id AS dst FROM ranked WHERE rank <= 9 AND similarity > 0.35 AND query_id < item_id)"""


_GREEDY = f"""WITH RECURSIVE {_EDGES.replace("edges AS (", "edges AS MATERIALIZED (")}, adj AS MATERIALIZED (SELECT src, list(dst) AS d FROM edges GROUP BY src),
    ids AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n, d FROM embeddings LEFT JOIN adj ON src = vec_id),
    walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS gone UNION ALL SELECT i.n, CASE WHEN i.d IS NULL OR list_contains(w.gone, i.vec_id) THEN w.gone ELSE
      list_distinct(list_concat(w.gone, i.d)) END FROM walk w JOIN ids i ON i.n = w.n + 1),
    last AS MATERIALIZED (SELECT gone FROM walk ORDER BY n DESC LIMIT 1), stay AS (SELECT vec_id AS id FROM ids, last WHERE NOT list_contains(gone, vec_id))"""


@register("near_dup_greedy", f"{_GREEDY} SELECT id FROM stay")
def near_dup_greedy(spark, sf):
    v = vectors(spark, sf)
    return dedup.greedy_survivors(v, dedup.duplicate_edges(v, 0.35, dedup.REFERENCE_NEIGHBOURS), "id")


@register(
    "near_dup_links",
    f"""{_GREEDY}, ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)
    SELECT vec_id AS id, (SELECT count(*) FROM ends WHERE ends.id = vec_id) AS n_links, vec_id IN (SELECT id FROM stay) AS kept FROM ids""",
)
def near_dup_links(spark, sf):
    """One row per item: how many links it has, and whether it stays."""
    v = vectors(spark, sf)
    return dedup.item_links(v, dedup.duplicate_edges(v, 0.35, dedup.REFERENCE_NEIGHBOURS))


@register("dedup_preview", f"WITH {_EDGES} SELECT src, dst FROM edges ORDER BY src, dst LIMIT 5")
def dedup_preview(spark, sf):
    return dedup.pair_preview(dedup.duplicate_edges(vectors(spark, sf), 0.35, dedup.REFERENCE_NEIGHBOURS))


@register("dedup_kept", f"{_GREEDY} SELECT id, round(embedding[1], 6) AS first FROM stay JOIN embeddings ON vec_id = id")
def dedup_kept(spark, sf):
    """The items that stay, with what they carry."""
    kept = dedup.deduplicate(vectors(spark, sf), 0.35, dedup.REFERENCE_NEIGHBOURS)[0]
    return kept.select("id", F.round(F.col("embedding")[0], 6).alias("first"))


@register("dedup_report", f"{_GREEDY} SELECT (SELECT count(*) FROM ids) AS before_dedup, count(*) AS after_dedup, (SELECT count(*) FROM ids) - count(*) AS duplicates_removed, 0.35::DOUBLE AS threshold FROM stay")
def dedup_report(spark, sf):
    return dedup.deduplicate(vectors(spark, sf), 0.35, dedup.REFERENCE_NEIGHBOURS)[1]


@register(
    "centroid_by_label",
    """WITH long AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
    SELECT label, pos::INT AS pos, round(avg(x), 6) AS mean FROM long GROUP BY label, pos""",
)
def centroid_by_label(spark, sf):
    means = V.mean_vectors(table(spark, sf, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("pos", "mean")).select("label", "pos", F.round("mean", 6).alias("mean"))


@register(
    "adjacent_similarity",
    f"WITH e AS (SELECT *, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) SELECT a.label, a.vec_id, round({_DOT.format('a', 'b')}, 6) AS similarity FROM e a LEFT JOIN embeddings b ON b.vec_id = a.nxt",
)
def adjacent_similarity(spark, sf):
    out = V.adjacent_similarity(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return out.withColumn("similarity", F.round("similarity", 6))


@register("unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), lambda y: y * y))), 6) AS norm FROM embeddings")
def unit_vectors(spark, sf):
    return vectors(spark, sf).select(F.col("id").alias("vec_id"), F.round(V.norm(V.normalise(F.col("embedding"))), 6).alias("norm"))


# ---- BM25, over the chunks, for every question and for every section title ----

_BM25 = r"""one AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1),
docs AS (SELECT chunk_id, source_file, page_content, regexp_extract_all(lower(coalesce(page_content, '')), '[\p{L}\p{N}_]+') AS t FROM one),
post AS (SELECT chunk_id, len(t) AS dl, u AS term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS u FROM docs) GROUP BY chunk_id, len(t), u),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM docs),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS i FROM post, size GROUP BY term, n),
idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM raw) ELSE i END AS idf FROM raw),
score AS (SELECT q.qid, p.chunk_id, round(sum(q.qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM asked q JOIN post p USING (term) JOIN idf USING (term), size GROUP BY q.qid, p.chunk_id),
sparse AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS sparse_rank FROM score WHERE score > 0 QUALIFY sparse_rank <= 15)"""
_SECTIONS = r"""titles AS (SELECT DISTINCT parent_section AS qid, regexp_extract_all(lower(parent_section), '[\p{L}\p{N}_]+') AS t FROM chunks WHERE parent_section IS NOT NULL),
asked AS (SELECT qid, u AS term, count(*) AS qtf FROM (SELECT qid, unnest(t) AS u FROM titles) GROUP BY qid, u)"""


def search_corpus(spark, sf):
    return chunks(spark, sf, "source_file", "page_content").select("chunk_id", "source_file", "page_content", T.tokenise(F.coalesce("page_content", F.lit(""))).alias("tokens"))


def _titles(spark, sf):
    rows = table(spark, sf, "chunks").where("parent_section is not null").select(F.col("parent_section").alias("qid")).distinct()
    return rows.select("qid", T.tokenise(F.col("qid")).alias("tokens"))


@register("bm25_sections", f"WITH {_SECTIONS}, {_BM25} SELECT qid, chunk_id, round(score, 6) AS score, sparse_rank::INT AS sparse_rank FROM sparse")
def bm25_sections(spark, sf):
    scores = retrieval.bm25_scores(_titles(spark, sf), search_corpus(spark, sf), "qid", "chunk_id")
    return retrieval.sparse_ranks(scores, "qid", "chunk_id").withColumn("score", F.round("score", 6))


@register(
    "bm25_questions",
    rf"""WITH q AS (SELECT DISTINCT triple_id AS qid, question FROM qa_triples WHERE question IS NOT NULL AND triple_id % 20 = 0), tq AS (SELECT qid, regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+') AS t FROM q),
    asked AS (SELECT qid, u AS term, count(*) AS qtf FROM (SELECT qid, unnest(list_concat(t, list_filter(t, lambda x: length(x) > 2 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.STOP_WORDS)}], x) AND regexp_full_match(x, '[\p{{L}}\p{{N}}]+')))) AS u FROM tq) GROUP BY qid, u),
    {_BM25} SELECT qid, chunk_id, sparse_rank::INT AS sparse_rank FROM sparse WHERE sparse_rank <= 5""",
)
def bm25_questions(spark, sf):
    """The five best chunks for every twentieth question, with expanded queries, among all chunks."""
    asked = table(spark, sf, "qa_triples").where("question is not null and triple_id % 20 = 0").select(F.col("triple_id").alias("qid"), "question").distinct()
    asked = asked.select("qid", T.expand_query(F.col("question")).alias("tokens"))
    return retrieval.bm25_ranks(asked, search_corpus(spark, sf), "qid", "chunk_id", 5).select("qid", "chunk_id", "sparse_rank")


_USABLE = "ev AS (SELECT chunk_id, any_value(embedding) AS embedding FROM chunk_embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true) AND list_contains(list_transform(embedding, lambda x: x <> 0), true) GROUP BY chunk_id)"
_HYBRID = rf"""{_SECTIONS}, {_BM25}, {_USABLE},
member AS (SELECT parent_section AS qid, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM one JOIN ev USING (chunk_id) WHERE parent_section IS NOT NULL),
centre AS (SELECT qid, list(m ORDER BY pos) AS embedding FROM (SELECT qid, pos, avg(x) AS m FROM member GROUP BY qid, pos) GROUP BY qid),
dsim AS (SELECT a.qid, b.chunk_id, round({_DOT.format('a', 'b')}, 6) AS similarity FROM centre a, ev b),
dense AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_id) AS dense_rank FROM dsim QUALIFY dense_rank <= 15),
fused AS (SELECT qid, chunk_id, dense_rank, sparse_rank, round(coalesce(0.6 / (60 + dense_rank), 0) + coalesce(0.4 / (60 + sparse_rank), 0), 6) AS rrf_score FROM dense FULL JOIN sparse USING (qid, chunk_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 5)"""


def _fused(spark, sf, **weights):
    titles, corpus = _titles(spark, sf), search_corpus(spark, sf)
    raw = table(spark, sf, "chunk_embeddings").where("size(embedding) = 64")
    good = ~F.exists("embedding", F.isnan) & F.exists("embedding", lambda x: x != 0)
    items = raw.where(good).dropDuplicates(["chunk_id"]).select(F.col("chunk_id").alias("id"), "embedding")
    member = chunks(spark, sf, "parent_section").where("parent_section is not null").select(F.col("parent_section").alias("qid"), F.col("chunk_id").alias("id")).join(items, "id")
    centre = V.mean_vectors(member, ["qid"], "embedding").withColumnRenamed("qid", "id")
    dense = V.exact_top_k(centre, items, 15).select(F.col("query_id").alias("qid"), F.col("item_id").alias("chunk_id"), F.col("rank").alias("dense_rank"))
    sparse = retrieval.sparse_ranks(retrieval.bm25_scores(titles, corpus, "qid", "chunk_id"), "qid", "chunk_id")
    return retrieval.fuse(dense, sparse, "qid", "chunk_id", **weights), corpus


@register("hybrid_retrieval", f"WITH {_HYBRID} SELECT qid, chunk_id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, rrf_score, rank::INT AS rank FROM top")
def hybrid_retrieval(spark, sf):
    """Section titles as queries over all chunks: dense, BM25, fusion."""
    return _fused(spark, sf)[0].select("qid", "chunk_id", "dense_rank", "sparse_rank", "rrf_score", "rank")


_WEIGHED = _HYBRID.replace("coalesce(0.6 / (60 + dense_rank), 0) + coalesce(0.4 / (60 + sparse_rank), 0)", "coalesce(1.0 / (60 + sparse_rank), 0)")


@register("hybrid_without_dense_weight", f"WITH {_WEIGHED} SELECT qid, chunk_id, rrf_score, rank::INT AS rank FROM top")
def hybrid_without_dense_weight(spark, sf):
    """A weight of 0 is honoured: dense finds take part with a score of 0."""
    return _fused(spark, sf, dense_weight=0.0, sparse_weight=1.0)[0].select("qid", "chunk_id", "rrf_score", "rank")


@register("retrieval_package", f"WITH {_HYBRID} SELECT qid, array_to_string(list(chunk_id ORDER BY rank), ',') AS ids, array_to_string(list(coalesce(source_file, '') ORDER BY rank), ',') AS sources, count(*)::INT AS n FROM top JOIN docs USING (chunk_id) GROUP BY qid")
def retrieval_package(spark, sf):
    fused, corpus = _fused(spark, sf)
    got = retrieval.package(fused, corpus, "qid", "chunk_id")
    return got.select("qid", F.array_join("retrieved_chunk_ids", ",").alias("ids"), F.array_join(F.transform("retrieved_sources", lambda s: F.coalesce(s, F.lit(""))), ",").alias("sources"), F.size("retrieval_details").alias("n"))


# ---- graph ----

_SETS = """nodes AS (SELECT chunk_id, any_value(source_file) AS source_file, any_value(parent_section) AS parent_section, any_value(entities) AS entities, any_value(keyphrases) AS keyphrases FROM kg_nodes GROUP BY chunk_id),
sets AS (SELECT chunk_id, list_sort(list_filter(list_distinct(list_transform({0}, lambda e: lower(trim(e)))), lambda e: e <> '')) AS terms FROM nodes),
classes AS (SELECT min(chunk_id) AS class_id, terms, count(*) AS n_members FROM sets WHERE len(terms) > 0 GROUP BY terms)"""
_PAIRS = """SELECT a.class_id AS source_id, b.class_id AS target_id, '{1}' AS relationship_type, array_to_string(list_sort(list_intersect(a.terms, b.terms)), '|') AS shared,
  round(len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))), 6) AS strength
  FROM classes a JOIN classes b ON a.class_id < b.class_id WHERE len(list_intersect(a.terms, b.terms)) > 0 AND len(list_intersect(a.terms, b.terms)) / len(list_distinct(list_concat(a.terms, b.terms))) >= 0.05"""


def nodes(spark, sf):
    return graph.distinct_nodes(table(spark, sf, "kg_nodes"))


def _class_edges(spark, sf, column, kind):
    edges = graph.class_edges(graph.term_classes(nodes(spark, sf), column)[0], kind)
    return edges.select("source_id", "target_id", "relationship_type", F.array_join("shared_properties", "|").alias("shared"), "strength")


@register("entity_edges", f"WITH {_SETS.format('entities')} {_PAIRS.format('', graph.ENTITY)}")
def entity_edges(spark, sf):
    return _class_edges(spark, sf, "entities", graph.ENTITY)


@register("keyphrase_edges", f"WITH {_SETS.format('keyphrases')} {_PAIRS.format('', graph.KEYPHRASE)}")
def keyphrase_edges(spark, sf):
    return _class_edges(spark, sf, "keyphrases", graph.KEYPHRASE)


@register("entity_membership", f"WITH {_SETS.format('entities')} SELECT chunk_id, class_id FROM sets JOIN classes USING (terms)")
def entity_membership(spark, sf):
    return graph.term_classes(nodes(spark, sf), "entities")[1]


@register("keyphrase_membership", f"WITH {_SETS.format('keyphrases')} SELECT chunk_id, class_id FROM sets JOIN classes USING (terms)")
def keyphrase_membership(spark, sf):
    return graph.term_classes(nodes(spark, sf), "keyphrases")[1]


@register(
    "section_groups",
    "WITH one AS (SELECT DISTINCT chunk_id, source_file, parent_section FROM kg_nodes WHERE source_file IS NOT NULL AND coalesce(parent_section, '') <> '') SELECT chunk_id, min(chunk_id) OVER w AS class_id, count(*) OVER w AS n_members FROM one WINDOW w AS (PARTITION BY source_file, parent_section)",
)
def section_groups(spark, sf):
    return graph.section_groups(nodes(spark, sf))


def _all_edges(column: str, kind: str) -> str:
    return f"""SELECT a.chunk_id AS source_id, b.chunk_id AS target_id, '{kind}' AS relationship_type, round(len(list_intersect(a.{column}, b.{column})) / len(list_distinct(list_concat(a.{column}, b.{column}))), 6) AS strength
      FROM clean a JOIN clean b ON a.chunk_id < b.chunk_id WHERE len(list_intersect(a.{column}, b.{column})) > 0 AND len(list_intersect(a.{column}, b.{column})) / len(list_distinct(list_concat(a.{column}, b.{column}))) >= 0.05"""


_GRAPH = f"""nodes AS (SELECT chunk_id, any_value(source_file) AS source_file, any_value(parent_section) AS parent_section, any_value(entities) AS entities, any_value(keyphrases) AS keyphrases FROM kg_nodes GROUP BY chunk_id),
clean AS (SELECT chunk_id, source_file, parent_section, list_filter(list_distinct(list_transform(entities, lambda e: lower(trim(e)))), lambda e: e <> '') AS e, list_filter(list_distinct(list_transform(keyphrases, lambda e: lower(trim(e)))), lambda e: e <> '') AS k FROM nodes),
edges AS ({_all_edges('e', graph.ENTITY)} UNION ALL {_all_edges('k', graph.KEYPHRASE)} UNION ALL
  SELECT a.chunk_id, b.chunk_id, '{graph.SECTION}', 0.5 FROM clean a JOIN clean b ON a.chunk_id < b.chunk_id AND a.source_file = b.source_file AND a.parent_section = b.parent_section AND a.parent_section <> '')"""


@register("edge_type_counts", f"WITH {_GRAPH} SELECT relationship_type, count(*) AS n_edges FROM edges GROUP BY relationship_type")
def edge_type_counts(spark, sf):
    return graph.edge_type_counts(nodes(spark, sf))


@register(
    "multihop_pairs",
    f"""WITH {_GRAPH} SELECT e.*, a.source_file IS DISTINCT FROM b.source_file AS cross_document FROM edges e JOIN nodes a ON a.chunk_id = source_id JOIN nodes b ON b.chunk_id = target_id WHERE strength BETWEEN 0.4 AND 0.82
    ORDER BY (a.source_file IS DISTINCT FROM b.source_file) DESC, source_id, target_id, list_position(['{graph.ENTITY}', '{graph.KEYPHRASE}', '{graph.SECTION}'], relationship_type) LIMIT 50""",
)
def multihop_pairs(spark, sf):
    return graph.multihop_pairs(nodes(spark, sf)).drop("shared_properties")


@register("node_edges", f"WITH {_GRAPH} SELECT source_id, target_id, relationship_type, strength FROM edges WHERE source_id = 7 OR target_id = 7")
def node_edges(spark, sf):
    """All edges of one node."""
    n = nodes(spark, sf)
    return graph.node_edges(n, graph.node_by_id(n, 7).select("chunk_id")).drop("shared_properties")


@register(
    "multihop_pairs_by_strength",
    f"""WITH {_GRAPH} SELECT e.*, a.source_file IS DISTINCT FROM b.source_file AS cross_document FROM edges e JOIN nodes a ON a.chunk_id = source_id JOIN nodes b ON b.chunk_id = target_id WHERE strength BETWEEN 0.4 AND 0.82
    ORDER BY round(abs(strength - 0.61), 6), source_id, target_id, list_position(['{graph.ENTITY}', '{graph.KEYPHRASE}', '{graph.SECTION}'], relationship_type) LIMIT 50""",
)
def multihop_pairs_by_strength(spark, sf):
    """Without preferring pairs across files: the nearest to the middle of the band first."""
    return graph.multihop_pairs(nodes(spark, sf), prefer_cross=False).drop("shared_properties")


@register("graph_stored", f"WITH {_SETS.format('entities')}, pairs AS ({_PAIRS.format('', graph.ENTITY)}) SELECT (SELECT count(*) FROM nodes) AS n_nodes, count(*) AS n_edges, sum(strength::DECIMAL(18,6))::DOUBLE AS total FROM pairs")
def graph_stored(spark, sf):
    """Nodes and edges between classes, saved and loaded."""
    n = nodes(spark, sf)
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    graph.save_graph(n, graph.class_edges(graph.term_classes(n, "entities")[0], graph.ENTITY), path)
    held, edges = graph.load_graph(spark, path)
    total = edges.agg(F.count("*").alias("n_edges"), F.sum(F.col("strength").cast("decimal(18,6)")).cast("double").alias("total"))
    return held.agg(F.count("*").alias("n_nodes")).crossJoin(total)
