import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import reporting, scenarios, scoring
from millrace.sources import sheets
from millrace.sources.stores import KeyedStore

SCORES = "struct<faithfulness double, relevance double, completeness double, tone double, follow_up_quality double, multi_hop_validity double>"


def test_overall_score(spark):
    s = (0.95, 0.90, 0.85, 0.80, 0.75, 1.0)
    df = spark.createDataFrame([("factual", s), (" MultiHop", s), (None, None), ("factual", (float("nan"), None, 1.0, 0.0, 0.0, 0.0))], f"t string, v {SCORES}")
    got = [round(r.x, 6) for r in df.select(scoring.overall_score(df.v, df.t, set(scoring.WEIGHTS_MULTIHOP)).alias("x")).collect()]
    assert got == [0.875, 0.90, 0.0, 0.2]


def test_verdicts_and_retries(spark):
    df = spark.createDataFrame([(1, 0.7), (2, 0.69), (3, 0.55), (4, 0.54), (5, None), (6, float("nan"))], "k int, quality_score double")
    got = {r.k: r.v for r in df.select("k", scoring.verdict(df.quality_score).alias("v")).collect()}
    assert got == {1: "accepted", 2: "borderline", 3: "borderline", 4: "rejected", 5: "rejected", 6: "rejected"}
    assert df.select(scoring.verdict(F.lit(0.3), 0.4).alias("v")).first().v == "borderline"
    again = spark.createDataFrame([(2, 0.8), (3, 0.6)], "k int, quality_score double")
    after = {r.k: r.quality_score for r in scoring.apply_retries(df.where("k < 5"), again, "k").collect()}
    assert after == {1: 0.7, 2: 0.8, 3: 0.55, 4: 0.54}
    report = scoring.quality_report(df).first()
    assert (report.total_validated, report.total_rejected, report.total_borderline, report.failed_validation) == (1, 5, 2, 2)


def test_samples(spark):
    df = spark.range(1000).toDF("k")
    rows = [r.k for r in scoring.exact_sample(df, "k", 0.3).collect()]
    order = sorted(range(1000), key=lambda k: (int(hashlib.md5(f"1:{k}".encode()).hexdigest()[:15], 16), k))[:300]
    assert sorted(rows) == sorted(order)
    assert scoring.exact_sample(df.limit(2), "k", 0.3).count() == 1 and scoring.exact_sample(df.limit(0), "k", 0.3).count() == 0
    assert 60 < scoring.bernoulli_sample(df, "k", 0.1).count() < 140


def test_scenarios(spark):
    rows = scenarios.scenarios(spark.range(900).toDF("i"), "i").collect()
    assert rows[0].persona == "beginner" and rows[7].persona == "impatient" and rows[7].query_style == "web_search"
    counts = {}
    for r in rows:
        counts[r.target_type] = counts.get(r.target_type, 0) + 1
    assert counts == {"factual": 250, "explanatory": 200, "procedural": 150, "comparative": 150, "inferential": 100, "scenario": 50}
    mixed = scenarios.scenarios(spark.range(45).toDF("i"), "i", mixed_radix=True)
    assert mixed.select("persona", "query_style", "query_length").distinct().count() == 45
    only = scenarios.scenarios(spark.range(4).toDF("i"), "i", personas=["expert", "nobody"], styles=["nothing"]).collect()
    assert {r.persona for r in only} == {"expert"} and {r.query_style for r in only} == set(scenarios.STYLE_NAMES)
    quota = spark.range(1).select(scenarios.type_quota(F.lit(10)).alias("q")).first().q
    assert quota.count("factual") == 2 and quota.count("scenario") == 1 and "multihop" not in quota
    text = spark.range(1).select(scenarios.instruction(F.lit("expert"), F.lit("formal"), F.lit("short"), F.lit("factual")).alias("t")).first().t
    assert text.count("\n") == 4


def triples(spark):
    rows = [
        (1, "run-12345", "q1", "a1", "fq", "fa", ["x", "y"], 0.9, (0.9,) * 5), (2, "run-12345", "q2", None, "fq", "", ["x", "x"], float("nan"), None), (5, "run-12345", "q5", "a5", None, None, None, 0.5, None), (3, "other", "q3", "a3", "f", "g", [], None, None),
    ]
    s = "struct<faithfulness double, relevance double, completeness double, tone double, follow_up_quality double>"
    df = spark.createDataFrame(rows, f"triple_id long, run_id string, question string, answer string, follow_up_q string, follow_up_a string, retrieved_sources array<string>, quality_score double, validation_scores {s}")
    empty = {"question_type": "string", "difficulty": "string", "hop_count": "int", "source_chunk_id": "int", "retrieved_chunk_ids": "array<int>", "retrieval_details": "array<struct<chunk_id int, source_file string, rrf_score double, dense_rank int, sparse_rank int>>"}
    return df.withColumns({k: F.lit(None).cast(t) for k, t in empty.items()})


def test_conversations_and_sheets(spark):
    t = triples(spark)
    convs = {r.triple_id: r for r in reporting.conversations(t).collect()}
    assert {k: c.id for k, c in convs.items()} == {1: "run-1234-0", 2: "run-1234-1", 5: "run-1234-2", 3: "other-0"}
    assert [len(convs[k].messages) for k in (1, 2, 5, 3)] == [4, 2, 2, 4]
    assert convs[1].metadata.cross_document and not convs[2].metadata.cross_document and convs[5].metadata.source_file == ""
    sheet = reporting.conversation_sheet(reporting.conversations(t)).where("id = 'run-1234-0'").orderBy("turn").collect()
    assert [(r.turn, r.quality_score, r.cross_document) for r in sheet] == [(1, 0.9, "Yes"), (2, None, ""), (3, None, ""), (4, None, "")]
    qa = reporting.qa_sheet(t).orderBy("no").collect()
    assert [r.no for r in qa] == [1, 2, 3, 4] and qa[0].source_files == "x, y" and qa[1].quality_score == 0.0
    assert {r.triple_id for r in reporting.rejected_sheet(t).collect()} == {2, 3, 5}
    summary = reporting.run_summary(t)
    assert reporting.summary_sheet(summary, "run_id").where("metric = 'Cross Document' and run_id = 'run-12345'").first().value == "1"


def test_workbook(spark, tmp_path):
    t = triples(spark)
    path = sheets.write_xlsx({"QA Pairs": reporting.qa_sheet(t), "Rejected": reporting.rejected_sheet(t)}, str(tmp_path / "out.xlsx"))
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and "q1" in z.read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(ValueError):
        sheets.write_xlsx({"x": spark.range(5)}, str(tmp_path / "y.xlsx"), max_rows=4)
    folders = sheets.export_sheets({"QA Pairs": reporting.qa_sheet(t)}, str(tmp_path / "all"), "csv")
    assert spark.read.option("header", True).csv(folders[0]).count() == 4
    sheets.export_json(t.select("triple_id", "question"), str(tmp_path / "json"))
    assert {json.loads(r.value)["triple_id"] for r in spark.read.text(str(tmp_path / "json")).collect()} == {1, 2, 3, 5}


def test_costs(spark):
    calls = spark.createDataFrame([("a", "m", 1000, 500), ("a", "new", 2000, 0), ("b", "m", 0, 0)], "agent string, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 0.01, 0.02), ("default", 0.1, 0.2)], "model string, in_price double, out_price double")
    got = {r.agent: (r.calls, r.cost, r.models) for r in reporting.cost_rollup(reporting.call_costs(calls, prices)).collect()}
    assert got == {"a": (2, 0.22, "m,new"), "b": (1, 0.0, "m"), None: (3, 0.22, "m,new")}


def test_store_and_comparison(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), "id string, at double, note string", "id", "at")
    assert store.list().count() == 0
    make = lambda *rows: spark.createDataFrame(list(rows), store.schema)
    store.record(make(("a", 1.0, "x"), ("b", 2.0, "y")))
    store.record(make(("a", 3.0, "z")))
    assert [(r.id, r.note) for r in store.list().collect()] == [("a", "z"), ("b", "y")]
    assert store.get("a").first().at == 3.0 and store.delete("b") and not store.delete("b") and store.list(1).count() == 1
    runs = spark.createDataFrame([("a", 0.5, 3, "p"), ("b", 0.75, 3, "q")], "k string, score double, n int, tag string")
    fields = reporting.by_field(runs, "k", ["score", "n", "tag"])
    got = {r.field: (r.value_a, r.value_b, r.delta) for r in reporting.compare_experiments(fields, "k", "a", "b").collect()}
    assert got == {"score": ("0.5", "0.75", 0.25), "n": ("3", "3", 0.0), "tag": ("p", "q", None)}
    assert {r.field for r in reporting.compare_experiments(fields, "k", "a", "b", only_changed=True).collect()} == {"score", "tag"}


def test_runs(spark):
    runs = spark.createDataFrame([("a", "Completed ", "2025-01-01 00:00:00"), ("b", "running", "2025-01-01 00:00:00"), ("c", "failed", "2025-01-01 09:30:00"), ("d", None, None)], "run_id string, status string, at string").withColumn("started_at", F.to_timestamp("at"))
    now = F.lit("2025-01-01 10:00:00").cast("timestamp")
    assert {r.run_id for r in reporting.live_runs(runs, now).collect()} == {"b", "c", "d"}
    assert [r.run_id for r in reporting.recent(runs, "started_at", "run_id", 2).collect()] == ["c", "a"]
    t = spark.createDataFrame([(k, f"Alarm {k}", None) for k in range(40)], "triple_id long, question string, answer string")
    assert [r.triple_id for r in reporting.search_page(t, "aLaRm", 1).collect()] == list(range(30, 40))
