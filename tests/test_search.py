import math
import random

import numpy as np
import pytest

from millrace.functions import vectors as V
from millrace.operators import dedup, graph, retrieval


def vecs(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], "id long, embedding array<double>")


@pytest.mark.parametrize("blocked", [False, True])
def test_exact_top_k(spark, monkeypatch, blocked):
    if blocked:
        monkeypatch.setattr(V, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(V, "BLOCK_ROWS", 17)
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(60, 5)), 1)
    x[7] = x[3]
    df = vecs(spark, enumerate(x))
    got = {}
    for row in V.exact_top_k(df, df, 4, same=True).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.item_id, row.similarity))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for i in range(60):
        want = sorted((-s[i, j], j) for j in range(60) if j != i)[:4]
        assert [(j, pytest.approx(v)) for _, j, v in sorted(got[i])] == [(j, -v) for v, j in want]


def test_top_k_edges(spark):
    few = vecs(spark, [(1, [1, 0]), (2, [0, 0])])
    rows = {(r.query_id, r.item_id): r.similarity for r in V.exact_top_k(few, few, 5, same=True).collect()}
    assert rows == {(1, 2): 0.0, (2, 1): 0.0}
    assert V.exact_top_k(few, few.limit(0), 3).count() == 0 and V.exact_top_k(few.limit(0), few, 3).count() == 0


def test_cosine_and_means(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(V.cosine(df.a, df.b).alias("x")).collect()]
    assert got == [pytest.approx(math.sqrt(0.5)), 0.0, 0.0, 0.0]


def bm25(queries, docs):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    vocabulary = {t for d in docs.values() for t in d}
    df = {t: sum(t in d for d in docs.values()) for t in vocabulary}
    idf = {t: math.log(n - df[t] + 0.5) - math.log(df[t] + 0.5) for t in vocabulary}
    mean = sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    return {(q, d): sum(idf[t] * body.count(t) * 2.5 / (body.count(t) + 1.5 * (0.25 + 0.75 * len(body) / avg)) for t in terms if t in idf) for q, terms in queries.items() for d, body in docs.items()}


def test_bm25_and_fusion(spark):
    r = random.Random(3)
    docs = {k: [r.choice("abcdefgh" + "a" * 9) for _ in range(r.randint(1, 12))] for k in range(20)} | {99: []}
    queries = {0: ["b", "b", "a"], 1: ["z"], 2: ["h", "c"]}
    qs = spark.createDataFrame(list(queries.items()), "q int, tokens array<string>")
    ds = spark.createDataFrame(list(docs.items()), "d int, tokens array<string>")
    got = {(x.q, x.d): x.score for x in retrieval.bm25_scores(qs, ds, "q", "d").collect()}
    want = bm25(queries, docs)
    assert all(got.get(k, 0) == pytest.approx(v, abs=1e-9) for k, v in want.items()) and not any(q == 1 for q, _ in got)
    ranks = retrieval.sparse_ranks(retrieval.bm25_scores(qs, ds, "q", "d"), "q", "d", 5).collect()
    for q in (0, 2):
        order = sorted((-round(v, 9), d) for (k, d), v in want.items() if k == q and v > 0)[:5]
        assert [d for _, d in order] == [x.d for x in sorted((x for x in ranks if x.q == q), key=lambda x: x.sparse_rank)]


def test_fusion_values(spark):
    dense = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, dense_rank int")
    sparse = spark.createDataFrame([(1, 10, 1), (1, 12, 2)], "q int, d int, sparse_rank int")
    got = {r.d: (r.rrf_score, r["rank"]) for r in retrieval.fuse(dense, sparse, "q", "d").collect()}
    assert got == {10: (round(0.6 / 61 + 0.4 / 61, 6), 1), 11: (round(0.6 / 62, 6), 2), 12: (round(0.4 / 62, 6), 3)}
    only = retrieval.fuse(dense, sparse, "q", "d", dense_weight=0.0).orderBy("rank").collect()
    assert [r.d for r in only] == [10, 12, 11]
    assert retrieval.fuse(dense.limit(0), sparse, "q", "d").count() == 2


def test_greedy_elimination(spark):
    r = random.Random(5)
    edges, stay = [], {}
    for g in range(40):
        n = r.randint(2, 15)
        own = [(i, j) for i in range(n) for j in range(i + 1, n) if r.random() < 0.3]
        gone = set()
        for i in range(n):
            if i not in gone:
                gone |= {j for a, j in own if a == i}
        edges += [(100 * g + i, 100 * g + j) for i, j in own]
        stay |= {100 * g + i: i not in gone for i in range(n)}
    ids = spark.createDataFrame([(k,) for k in stay], "id long")
    got = {x.id for x in dedup.greedy_survivors(ids, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k for k, s in stay.items() if s}


def test_dedup_chain_and_copies(spark):
    a = math.acos(0.95)
    rows = [(0, [1, 0]), (1, [math.cos(a), math.sin(a)]), (2, [math.cos(2 * a), math.sin(2 * a)]), (3, [1, 0])]
    kept, report = dedup.deduplicate(vecs(spark, rows), 0.92)
    assert {r.id for r in kept.collect()} == {0, 2}
    assert report.first().duplicates_removed == 2
    assert dedup.deduplicate(vecs(spark, rows[:1]), 0.92)[0].count() == 1


@pytest.mark.parametrize("blocked", [False, True])
def test_groups_larger_than_the_neighbours(spark, monkeypatch, blocked):
    if blocked:
        monkeypatch.setattr(V, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(V, "BLOCK_ROWS", 14)
    r = np.random.default_rng(4)
    x = [[1, 0, 0]] * 30 + [list(v) for v in np.array([0, 1, 0]) + r.normal(size=(30, 3)) / 50] + [list(v) for v in r.normal(size=(20, 3))] + [[0, 0, 0]] * 2
    x = [x[i] for i in r.permutation(len(x))]
    u = np.array([np.array(v) / (np.linalg.norm(v) or 1) for v in x])
    near = np.round(u @ u.T, 6) > 0.92
    np.fill_diagonal(near, False)
    stay = []
    for i in range(len(x)):
        if not any(near[i, j] for j in stay):
            stay.append(i)
    items = vecs(spark, enumerate(x))
    kept, report = dedup.deduplicate(items, 0.92)
    assert sorted(q.id for q in kept.collect()) == stay
    assert report.first().duplicates_removed == len(x) - len(stay)
    edges = [(q.src, q.dst) for q in dedup.duplicate_edges(items, 0.92).collect()]
    assert sorted(edges) == [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if near[i, j]]
    want = {i: (near[i].sum(), i in stay) for i in range(len(x))}
    classes = dedup.vector_classes(items)
    first = items.join(classes.where("id = class_id").select("id"), "id", "left_semi")
    assert {q.id: (q.n_links, q.kept) for q in dedup.item_links(items, dedup.duplicate_edges(first), classes).collect()} == want
    assert dedup.deduplicate(items, 1.0)[0].count() == len(x)


def test_links_and_copies(spark):
    items = vecs(spark, [(k, [1, k]) for k in range(4)])
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert {r.id: (r.n_links, r.kept) for r in dedup.item_links(items, edges).collect()} == {0: (1, True), 1: (2, False), 2: (1, True), 3: (0, True)}
    docs = spark.createDataFrame([(5, "x"), (3, "x"), (4, "y"), (9, None)], "d long, t string")
    assert {r.d: (r.class_id, r.n_copies) for r in dedup.copy_classes(docs, "d", "t").collect()} == {5: (3, 2), 3: (3, 2), 4: (4, 1)}
    assert dedup.item_links(items.limit(0), edges.limit(0)).count() == 0


def nodes(spark, rows):
    return spark.createDataFrame(rows, "chunk_id int, source_file string, entities array<string>, keyphrases array<string>, parent_section string")


def test_graph_against_all_pairs(spark):
    r = random.Random(9)
    pick = lambda k: r.choice([None, [], [r.choice(["A", "a ", "B", "c", "D", "e", ""]) for _ in range(k)]])
    rows = [(k, r.choice(["x", "y", None]), pick(3), pick(2), r.choice(["s", "t", "", None])) for k in range(40)]
    df = nodes(spark, rows)
    sets = lambda v: {t.strip().lower() for t in v or []} - {""}
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            for kind, col in (("shared_entity", 2), ("shared_keyphrase", 3)):
                x, y = sets(a[col]), sets(b[col])
                if x & y and len(x & y) / len(x | y) >= 0.05:
                    want[a[0], b[0], kind] = round(len(x & y) / len(x | y), 6)
            if a[1] and a[1] == b[1] and a[4] and a[4] == b[4]:
                want[a[0], b[0], "hierarchical"] = 0.5
    got = {(e.source_id, e.target_id, e.relationship_type): e.strength for e in graph.node_edges(df, df.select("chunk_id")).collect()}
    assert got == pytest.approx(want)
    counts = {x.relationship_type: x.n_edges for x in graph.edge_type_counts(df).collect()}
    assert counts == {k: sum(e[2] == k for e in want) for k in graph.TYPES}
    files = {row[0]: row[1] for row in rows}
    order = sorted((files[i] == files[j], i, j, graph.TYPES.index(k)) for (i, j, k), s in want.items() if 0.4 <= s <= 0.82)
    top = graph.multihop_pairs(df, most=7).collect()
    assert [(not p.cross_document, p.source_id, p.target_id, graph.TYPES.index(p.relationship_type)) for p in top] == order[:7]
    assert len({(p.source_id, p.target_id) for p in graph.multihop_pairs(df, most=500, distinct_pairs=True).collect()}) == len({o[1:3] for o in order})
    near = graph.multihop_pairs(df, most=5, prefer_cross=False).collect()
    assert [abs(p.strength - 0.61) for p in near] == sorted(abs(p.strength - 0.61) for p in near)


def test_graph_round_trip_and_plans(spark, tmp_path):
    df = nodes(spark, [(1, "x", ["a"], ["p"], "s"), (2, "x", ["a", "b"], None, "s")])
    edges = graph.class_edges(graph.term_classes(df, "entities")[0], "shared_entity")
    graph.save_graph(df, edges, str(tmp_path))
    n, e = graph.load_graph(spark, str(tmp_path))
    assert n.count() == 2 and e.collect() == edges.collect() and graph.incident_edges(e, 2).count() == 1 and graph.node_by_id(n, 2).count() == 1
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan
    with pytest.raises(ValueError):
        graph.class_edges(graph.term_classes(df, "entities")[0], "x", 0)


@pytest.mark.parametrize("rows", [4096, 3])
def test_class_edges_meet_once_and_are_not_shuffled(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "LIST_ROWS", rows)
    monkeypatch.setattr(graph, "MEETINGS", 500)
    r = random.Random(11)
    sets = {k: {f"t{r.randint(0, 99)}" for _ in range(r.choice([1, 2, 4, 60, 90]))} for k in range(60)}
    df = nodes(spark, [(k, "x", sorted(v), None, "s") for k, v in sets.items()])
    edges = graph.class_edges(graph.term_classes(df, "entities")[0], "shared_entity")
    want, first = {}, {}
    for k, v in sets.items():
        first.setdefault(frozenset(v), k)
    for i, a in ((k, s) for s, k in first.items()):
        for j, b in ((k, s) for s, k in first.items()):
            if i < j and a & b and len(a & b) >= 0.05 * len(a | b):
                want[i, j] = (sorted(a & b), round(len(a & b) / len(a | b), 6))
    got = edges.collect()
    assert {(e.source_id, e.target_id): (e.shared_properties, e.strength) for e in got} == want and len(got) == len(want)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.index("Join Inner") < plan.index("Repartition")


def test_stored_edges_are_small(spark, tmp_path):
    r = random.Random(12)
    ids = r.sample(range(1 << 20), 1600)
    df = nodes(spark, [(k, "x", [f"e{n % 4}", f"own{k}"], None, "s") for n, k in enumerate(ids)])
    edges = graph.class_edges(graph.term_classes(df, "entities")[0], "shared_entity")
    graph.save_graph(df, edges, str(tmp_path))
    _, held = graph.load_graph(spark, str(tmp_path))
    assert held.count() == 4 * 400 * 399 // 2 and held.exceptAll(edges).count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "edges").glob("*.parquet")) < held.count() / 2


@pytest.mark.parametrize("least", [0.05, 0.2, 0.5])
def test_edges_are_counted_without_pairs(spark, monkeypatch, least):
    r = random.Random(13)
    sets = {k: {f"t{r.randint(0, 9 if k % 3 else 25)}" for _ in range(r.choice([1, 2, 3, 5, 7, 20]))} for k in range(90)}
    df = nodes(spark, [(k, "x", sorted(v), sorted(v)[:3], "s") for k, v in sets.items()])
    near = lambda a, b: len(a & b) >= least * len(a | b)
    count = lambda s: sum(near(s[i], s[j]) for i in s for j in s if i < j)
    got = {x.relationship_type: x.n_edges for x in graph.edge_type_counts(df, least=least).collect()}
    assert got == {"shared_entity": count(sets), "shared_keyphrase": count({k: set(sorted(v)[:3]) for k, v in sets.items()}), "hierarchical": 90 * 89 // 2}
    assert graph.edge_type_counts(df.limit(0)).where("n_edges = 0").count() == 3
    if least == 0.05:
        few = graph.linked_nodes(graph.term_classes(df, "keyphrases")[0])
        assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("low, high", [(0.4, 0.82), (0.3, 1.0), (0.55, 0.7)])
def test_nearest_edges_without_unfolding_all(spark, monkeypatch, low, high):
    r = random.Random(14)
    pick = lambda: [r.choice("abcdefgh") for _ in range(r.choice([1, 2, 3]))]
    rows = [(k, r.choice("xy"), pick(), pick(), r.choice(["s", "t", None])) for k in r.sample(range(500), 80)]
    df = nodes(spark, rows)
    kind = {k: n for n, k in enumerate(graph.TYPES)}
    unfolded = graph.node_edges(df, df.select("chunk_id")).collect()
    band = [e for e in unfolded if low <= e.strength <= high]
    order = sorted((round(abs(e.strength - (low + high) / 2), 6), e.source_id, e.target_id, kind[e.relationship_type], e.shared_properties) for e in band)
    monkeypatch.setattr(graph, "node_edges", None)
    for most in (3, 50, 100_000):
        got = graph.multihop_pairs(df, low=low, high=high, most=most, prefer_cross=False).collect()
        assert [(round(abs(e.strength - (low + high) / 2), 6), e.source_id, e.target_id, kind[e.relationship_type], e.shared_properties) for e in got] == order[:most]


@pytest.mark.parametrize("slices", [False, True])
def test_bm25_ranks_without_pairs(spark, monkeypatch, slices):
    if slices:
        monkeypatch.setattr(retrieval, "WEIGHTS", 9)
        monkeypatch.setattr(retrieval, "bm25_scores", None)
    r = random.Random(15)
    docs = {k: [r.choice("abcdefgh" + "a" * 9) for _ in range(r.randint(1, 8))] for k in r.sample(range(1000), 300)} | {1001: []}
    queries = {k: [r.choice("abcdefghz") for _ in range(r.randint(1, 4))] for k in range(12)} | {12: []}
    qs = spark.createDataFrame(list(queries.items()), "q long, tokens array<string>")
    ds = spark.createDataFrame(list(docs.items()), "d int, tokens array<string>").repartition(3)
    got = retrieval.bm25_ranks(qs, ds, "q", "d", 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and got.schema["d"].dataType.simpleString() == "int"
    want = bm25(queries, docs)
    ranked = {(x.q, x.sparse_rank): x.d for x in got.collect()}
    for q in queries:
        order = sorted((-round(v, 9), d) for (k, d), v in want.items() if k == q and v > 0)[:5]
        assert [ranked.get((q, n + 1)) for n in range(5)] == [d for _, d in order] + [None] * (5 - len(order))


def test_answers_without_a_row_for_each_pair(spark, monkeypatch):
    from __spark_entry__ import HOME, queries

    monkeypatch.setattr(retrieval, "bm25_scores", None)
    assert queries()["generated_answers"](spark, HOME).where("answer <> ''").count() > 0
