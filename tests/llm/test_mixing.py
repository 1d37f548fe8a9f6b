from collections import defaultdict

from millrace.llm.mixing import closing_time, mix, mix_report, shares, sourced_documents

DOC = "doc_id long, text string, source string, n_tokens string"
TARGET = "source string, weight_permille int, max_repeat int"


def build(spark, sizes):
    rows, k = [], 0
    for source, lengths in sizes.items():
        for n in lengths:
            rows.append((k, "w " * n, source, "clash"))
            k += 1
    return spark.createDataFrame(rows, DOC)


def run(spark, df, targets):
    docs = sourced_documents(df)
    plan, budget = shares(docs, spark.createDataFrame(targets, TARGET))
    mixed = mix(docs, plan, budget)
    return mixed, mix_report(mixed, plan, budget), plan, budget


def brute(plan, budget, docs, order):
    """Plain weighted fair queueing over the given order of each pass."""
    queue = []
    for s in plan:
        cum = 0
        for p in range(s.max_repeat if s.weight and s.available else 0):
            for d in order[s.source, p]:
                cum += docs[d]
                queue.append((cum / s.weight, s.source, p, d))
    out, total = [], 0
    for f, source, p, d in sorted(queue):
        if total + docs[d] > budget:
            break
        total += docs[d]
        out.append((source, p, d))
    return out


def test_shares_repeats_and_order(spark):
    df = build(spark, {"big": [7] * 400, " Small ": [5] * 30, "mid": [11, 3, 2] * 40, None: [9] * 50, "other": [4] * 60})
    targets = [("big", 500, 1), ("small", 300, 2), ("mid", 150, 1), ("absent", 50, 3)]
    mixed, report, plan, budget = run(spark, df, targets)
    rows = mixed.orderBy("n_upto").collect()
    upto = 0
    for r in rows:
        upto += r.n_tokens
        assert r.n_upto == upto
    assert upto <= budget and [r.finish for r in rows] == sorted(r.finish for r in rows)
    got = {r.source: r for r in report.collect()}
    assert got["small"].available == 150 and got["small"].taken == 300 and got["small"].n_passes == 2 and got["small"].short
    assert got["absent"].taken == 0 and got["absent"].short and not got["big"].short
    assert sum(r.taken for r in got.values()) == upto and budget - upto <= 11
    # the order inside a pass is the operator's; given it, the merge must be that of plain queueing
    sizes = {r.doc_id: r.n_tokens for r in sourced_documents(df).collect()}
    order = defaultdict(list)
    for r in rows:
        order[r.source, r["pass"]].append(r.doc_id)
    want = brute(plan, budget, sizes, order)
    assert [(r.source, r["pass"], r.doc_id) for r in rows] == want
    assert len({(r.doc_id, r["pass"]) for r in rows}) == len(rows)


def test_weights_hold_where_supply_allows(spark):
    df = build(spark, {"a": [3, 4, 5] * 300, "b": [6] * 300, "c": [2] * 900})
    _, report, _, _ = run(spark, df, [("a", 200, 1), ("b", 300, 1), ("c", 500, 2)])
    for r in report.collect():
        assert abs(r.actual_permille - r.weight_permille) < 8


def test_everything_runs_out(spark):
    df = build(spark, {"a": [5] * 10, "x": [5] * 90})
    mixed, report, plan, budget = run(spark, df, [("a", 1000, 2)])
    assert closing_time(plan, budget) == closing_time(plan, 10 * budget) == 0.1
    assert report.first().taken == 100 and mixed.count() == 20


def test_budget_is_spent_where_a_heavy_source_runs_out(spark):
    df = build(spark, {"heavy": [40] * 45, "light": [40] * 200})
    mixed, report, plan, budget = run(spark, df, [("heavy", 900, 1), ("light", 100, 1)])
    assert budget - mixed.agg({"n_tokens": "sum"}).first()[0] < 40
    got = {r.source: r for r in report.collect()}
    assert got["heavy"].short and got["heavy"].taken == 1800 and not got["light"].short


def test_empty_nulls_and_repeats(spark):
    targets = [("a", 1000, 2), (None, 5, 1), ("b", None, None)]
    mixed, report, _, budget = run(spark, spark.createDataFrame([], DOC), targets)
    assert mixed.count() == 0 and budget == 0 and report.count() == 2
    df = build(spark, {"a": [0, 8, 8]})
    mixed, report, _, _ = run(spark, df.unionByName(df), targets)
    assert mixed.count() == 1 and {r.source: r.available for r in report.collect()} == {"a": 16, "b": 0}
