import pytest
from pyspark.sql import functions as F

from millrace.config import PipelineConfig
from millrace.operators.models import CallPolicy, OfflineModel, reuse_embeddings
from millrace.plans.pipeline import ADMISSION, Pipeline, TooManyRuns, stages
from millrace.streaming.progress import ProgressLog, replay, run_states

WORDS = ["pressure", "filters", "storage", "reports", "cooling", "sealing", "network", "billing"]


def documents(spark, n=2):
    rows = []
    for d in range(n):
        body = " ".join(f"The {WORDS[(i + d) % 8]} record {i} describes how {WORDS[(i * 3 + d) % 8]} depends on {WORDS[i % 8]} every day." for i in range(30))
        rows.append((d, f"file{d}.docx", body))
    return spark.createDataFrame(rows, "doc_index int, source_file string, raw_text string")


def broken():
    """A client made where it is used: workers can't import this file."""

    class Broken(OfflineModel):
        def complete(self, prompts):
            raise RuntimeError("no service")

    return Broken


def test_a_whole_run(spark, tmp_path):
    config = PipelineConfig(max_questions_per_chunk=2, max_multihop_pairs=3, quality_threshold=0.6, dedup_threshold=0.98)
    log = ProgressLog(str(tmp_path / "log"), "run-one-1")
    out = Pipeline(spark, OfflineModel, config, CallPolicy(pause=0), log).run(documents(spark), "run-one-1")
    assert [p for p, _, _ in out.phases] == stages(config)
    t = out.tables
    n = t["triples"].count()
    assert n > 0 and t["validated"].count() + t["rejected"].count() == n
    assert t["validated"].where("quality_score < 0.6").count() == 0
    assert t["questions"].select("qa_idx").distinct().count() == t["questions"].count()
    assert t["conversations"].count() == t["validated"].count()
    assert all(len(r.messages) in (2, 4) for r in t["conversations"].collect())
    assert t["summary"].first().total_triples == n and t["summary"].first().documents_processed == 2
    assert out.phase_table(spark).count() == len(out.phases) and out.error_table(spark).count() == 0
    assert t["multihop_pairs"].count() <= 3
    state = run_states(replay(spark, str(tmp_path / "log"))).first()
    assert (state.status, state.progress_pct) == ("completed", 100)


def test_failures_are_reported(spark, tmp_path):
    log = ProgressLog(str(tmp_path / "log"), "r")
    out = Pipeline(spark, broken(), PipelineConfig(enable_knowledge_graph=False, enable_multihop=False), CallPolicy(tries=1), log).run(documents(spark, 1))
    assert out.tables["triples"].count() == 0 and out.error_table(spark).count() == out.tables["chunks"].count()
    with pytest.raises(ValueError):
        Pipeline(spark, OfflineModel, progress=log).run(documents(spark, 1).limit(0))
    assert run_states(replay(spark, str(tmp_path / "log"))).first().status == "failed"


def test_admission_and_settings(spark):
    taken = 0
    while ADMISSION.acquire(blocking=False):
        taken += 1
    with pytest.raises(TooManyRuns):
        Pipeline(spark, OfflineModel).run(documents(spark, 1))
    for _ in range(taken):
        ADMISSION.release()
    assert "knowledge_graph" not in stages(PipelineConfig(enable_knowledge_graph=False))
    assert PipelineConfig.of({"dense_weight": 0.0}).dense_weight == 0.0
    for bad in ({"quality_threshold": 1.5}, {"max_concurrent_calls": 0}, {"nothing": 1}):
        with pytest.raises(ValueError):
            PipelineConfig.of(bad)
    assert Pipeline(spark, OfflineModel).describe()["stages"][0] == "semantic_chunking"


def test_only_missing_vectors_are_asked_for(spark):
    df = spark.createDataFrame([(1, "abc", [1.0]), (2, "def", None), (3, None, None)], "k int, t string, v array<double>")
    got = {r.k: r.v for r in reuse_embeddings(df, "t", "v", OfflineModel).collect()}
    assert got[1] == [1.0] and len(got[2]) == 64 and got[3] is None


def test_advanced_metrics_query_measures_the_configured_share(spark, monkeypatch):
    from millrace.operators import generation
    from millrace.plans import stage_queries as Q

    rows = spark.range(1000).withColumnRenamed("id", "triple_id").withColumn("page_content", F.lit("text")).withColumn("chunk_id", F.col("triple_id"))
    seen = {}

    def measured(chosen, client, noise):
        seen.update(chosen=chosen.count(), noisy=noise.count())
        names = ["claim_faithfulness", "context_precision", "context_recall", "answer_relevancy", "noise_sensitivity", "answer_changed"]
        return chosen.select("triple_id", *(F.lit(0.0).alias(n) for n in names))

    monkeypatch.setattr(Q, "_in_context", lambda spark, sf: rows)
    monkeypatch.setattr(Q, "chunks", lambda spark, sf: rows)
    monkeypatch.setattr(generation, "advanced_metrics", measured)
    assert Q.advanced_metrics(spark, "").count() == 300
    assert seen["chosen"] == 300 and 10 <= seen["noisy"] <= 60


def test_http_client(spark):
    """Against a small server: one prompt is refused once and then answered."""
    import json
    import threading
    from functools import partial
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from millrace.operators.models import CallPolicy, HttpModel, completion, embedding

    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(self.path)
            if self.path.endswith("completions"):
                text = body["messages"][0]["content"]
                if text == "again" and seen.count(self.path) < 3 or text == "never":
                    self.send_response(503)
                    self.end_headers()
                    return
                out = {"choices": [{"message": {"content": text.upper()}}]}
            else:
                out = {"data": [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in reversed(list(enumerate(body["input"])))]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = partial(HttpModel, f"http://127.0.0.1:{server.server_port}/v1", "m", "e", 20.0)
        df = spark.createDataFrame([("one",), ("again",), ("never",), (None,)], "t string").coalesce(1)
        got = {r.t: r.c for r in df.select("t", completion(df.t, client, CallPolicy(1, 3, 0.01)).alias("c")).collect()}
        assert got["one"].text == "ONE" and got["again"].text == "AGAIN" and got[None].text is None
        assert got["never"].text is None and "503" in got["never"].error
        assert {r.t: r.v for r in df.select("t", embedding(df.t, client).alias("v")).collect()} == {"one": [3.0, 1.0], "again": [5.0, 1.0], "never": [5.0, 1.0], None: None}
    finally:
        server.shutdown()
