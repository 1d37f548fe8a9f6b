"""The whole run: documents to validated conversations, stage by stage, each stage a stored table."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, dedup, generation, graph, reporting, retrieval, scenarios, scoring
from ..operators.models import CallPolicy, ModelClient, embedding
from ..operators.ordering import numbered
from ..session import durable
from ..streaming.progress import ProgressLog

#: Runs that may work at a time in one driver.
ADMISSION = threading.BoundedSemaphore(3)
CRITERIA = list(scoring.WEIGHTS_MULTIHOP)


class TooManyRuns(RuntimeError):
    pass


@dataclass
class RunResult:
    run_id: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    phases: list[tuple[str, float, dict]] = field(default_factory=list)
    errors: list[DataFrame] = field(default_factory=list)

    def phase_table(self, spark: SparkSession) -> DataFrame:
        """One row per phase; nothing is overwritten by later phases."""
        rows = [(self.run_id, p, round(s, 2), {k: str(v) for k, v in m.items()}) for p, s, m in self.phases]
        return spark.createDataFrame(rows, "run_id string, phase string, duration double, metrics map<string,string>")

    def error_table(self, spark: SparkSession) -> DataFrame:
        out = spark.createDataFrame([], "phase string, error string")
        for e in self.errors:
            out = out.unionByName(e)
        return out


def stages(config: PipelineConfig) -> list[str]:
    """Names of the stages that a configuration runs, in order."""
    names = ["semantic_chunking", "knowledge_graph", "question_generation", "multihop_generator", "deduplication", "answer_generation", "quality_validation"]
    off = set() if config.enable_knowledge_graph else {"knowledge_graph"}
    return [n for n in names if n not in off | (set() if config.enable_multihop else {"multihop_generator"})]


class Pipeline:
    """Runs the stages over ``documents(doc_index, source_file, raw_text[, headings])``.

    Every stage that asks a model writes its answers before anything reads them. Chunks and
    questions keep explicit numbers; no stage depends on the place of a row.
    """

    def __init__(self, spark: SparkSession, factory: Callable[[], ModelClient], config: PipelineConfig = PipelineConfig(), policy: CallPolicy = CallPolicy(), progress: ProgressLog | None = None):
        self.spark, self.factory, self.config, self.policy, self.progress = spark, factory, config, policy, progress

    def run(self, documents: DataFrame, run_id: str | None = None) -> RunResult:
        if not ADMISSION.acquire(blocking=False):
            raise TooManyRuns("too many runs at a time; try again later")
        run_id = run_id or str(uuid.uuid4())
        result = RunResult(run_id)
        names = stages(self.config)
        try:
            self.spark.sparkContext.setJobGroup(run_id, f"run {run_id}")
            for n, name in enumerate(names, 1):
                if self.progress:
                    self.progress.phase_start(name, n)
                began = time.time()
                metrics = getattr(self, "_" + name)(documents, result)
                result.phases.append((name, time.time() - began, metrics))
                if self.progress:
                    self.progress.phase_complete(name, n, **metrics)
            result.tables["summary"] = self._summary(documents, result)
            if self.progress:
                self.progress.complete(run_id=run_id)
        except Exception as e:
            if self.progress:
                self.progress.fail(f"{type(e).__name__}: {e}")
            raise
        finally:
            ADMISSION.release()
        return result

    def _failed(self, result: RunResult, phase: str, errors: DataFrame) -> None:
        result.errors.append(errors.select(F.lit(phase).alias("phase"), "error"))

    def _semantic_chunking(self, documents: DataFrame, result: RunResult) -> dict:
        c = self.config
        sents = chunking.sentences(documents, "doc_index", "raw_text").withColumn("embedding", embedding(F.col("sentence"), self.factory, self.policy))
        sents = durable(sents.where("embedding is not null"), "sentences")
        made, means = chunking.chunk_by_vectors(sents, "doc_index", c.similarity_threshold, c.min_chunk_size, c.max_chunk_size)
        made = made.join(documents.select("doc_index", "source_file"), "doc_index").join(means, ["doc_index", "doc_chunk_id"])
        if "headings" in documents.columns:
            made = chunking.heading_paths(made, documents, "doc_index")
        else:
            made = made.withColumn("heading_path", F.lit(None).cast("array<string>")).withColumn("parent_section", F.lit(None).cast("string"))
        chunks = durable(chunking.global_ids(made, "doc_index", "doc_chunk_id"), "chunks")
        result.tables["chunks"] = chunks
        row = chunking.chunk_statistics(chunks).first()
        if not row["total_chunks"]:
            raise ValueError("no document has a usable sentence")
        return row.asDict() | {"total_sentences": sents.count()}

    def _knowledge_graph(self, _: DataFrame, result: RunResult) -> dict:
        nodes = generation.properties(result.tables["chunks"], self.factory, self.policy)
        result.tables["nodes"] = durable(nodes, "nodes")
        return {r["relationship_type"]: r["n_edges"] for r in graph.edge_type_counts(result.tables["nodes"]).collect()}

    def _question_generation(self, _: DataFrame, result: RunResult) -> dict:
        c, chunks = self.config, result.tables["chunks"]
        if c.enable_personas:
            chunks = scenarios.scenarios(chunks, "chunk_id", list(c.active_personas), list(c.active_styles), list(c.active_lengths))
            chunks = chunks.withColumn("scenario", scenarios.instruction(F.col("persona"), F.col("query_style"), F.col("query_length"), F.col("target_type")))
        asked, failed = generation.single_hop_questions(chunks, self.factory, self.policy, c.max_questions_per_chunk)
        self._failed(result, "question_generation", failed)
        asked = asked.withColumn("_key", F.col("source_chunk_id") * c.max_questions_per_chunk + F.col("item_no"))
        asked = durable(numbered(asked, [], "_key", "qa_idx").drop("_key"), "questions")
        kept = durable(generation.keep_by_verdict(asked, "qa_idx", self.factory, self.policy), "kept")
        result.tables["questions"] = kept.withColumn("hop_count", F.lit(1))
        return {"pre_filter_count": asked.count(), "total_questions": kept.count(), "failed_chunks": failed.count()}

    def _multihop_generator(self, _: DataFrame, result: RunResult) -> dict:
        c, chunks = self.config, result.tables["chunks"]
        if "nodes" in result.tables:
            pairs = graph.multihop_pairs(result.tables["nodes"], "chunk_id", c.multihop_similarity_min, c.multihop_similarity_max, c.max_multihop_pairs)
            pairs = pairs.select("source_id", "target_id", "strength")
        else:
            items = chunks.select(F.col("chunk_id").alias("id"), "embedding")
            files = chunks.select("chunk_id", "source_file")
            near = V.band_pairs(V.exact_top_k(items, items, 19, same=True), c.multihop_similarity_min, c.multihop_similarity_max)
            near = near.join(files.toDF("id_a", "_fa"), "id_a").join(files.toDF("id_b", "_fb"), "id_b")
            near = near.orderBy(F.when(F.col("_fa") != F.col("_fb"), 0).otherwise(1), F.desc("similarity"), "id_a", "id_b").limit(c.max_multihop_pairs)
            pairs = near.select(F.col("id_a").alias("source_id"), F.col("id_b").alias("target_id"), F.col("similarity").alias("strength"))
        asked, records = generation.multihop_questions(pairs, chunks, self.factory, self.policy, c.multihop_questions_per_pair)
        result.tables["multihop_pairs"] = durable(records, "pairs")
        first = result.tables["questions"]
        start = (first.agg(F.max("qa_idx")).first()[0] or 0) + 1
        # at most pairs x questions of them, a fixed number: one sort is enough
        asked = asked.withColumn("_key", F.col("source_chunk_ids")[0] * 1_000_003 + F.col("source_chunk_ids")[1] * c.multihop_questions_per_pair + F.col("item_no"))
        asked = numbered(durable(asked.dropDuplicates(["_key"]), "multihop"), [], "_key", "_n").withColumn("qa_idx", F.col("_n") + start).drop("_n", "_key")
        result.tables["questions"] = durable(first.unionByName(asked, allowMissingColumns=True), "questions")
        return {"candidate_pairs": pairs.count(), "pairs_with_bridges": records.count(), "questions_generated": asked.count()}

    def _deduplication(self, _: DataFrame, result: RunResult) -> dict:
        c = self.config
        asked = durable(result.tables["questions"].withColumn("embedding", embedding(F.col("question"), self.factory, self.policy)), "embedded")
        items = asked.where("embedding is not null").select(F.col("qa_idx").alias("id"), "embedding")
        stay, report = dedup.deduplicate(items, c.dedup_threshold, c.dedup_neighbours)
        result.tables["questions"] = durable(asked.join(stay.select(F.col("id").alias("qa_idx")), "qa_idx", "left_semi"), "distinct")
        result.tables["dedup_report"] = report
        return report.first().asDict()

    def _answer_generation(self, _: DataFrame, result: RunResult) -> dict:
        c, chunks, asked = self.config, result.tables["chunks"], result.tables["questions"]
        corpus = durable(chunks.select("chunk_id", "source_file", "page_content", T.tokenise(F.col("page_content")).alias("tokens")), "corpus")
        dense = V.exact_top_k(asked.select(F.col("qa_idx").alias("id"), "embedding"), chunks.select(F.col("chunk_id").alias("id"), "embedding"), 3 * c.top_k)
        dense = dense.select(F.col("query_id").alias("qa_idx"), F.col("item_id").alias("chunk_id"), F.col("rank").alias("dense_rank"))
        scores = retrieval.bm25_scores(asked.select("qa_idx", T.expand_query(F.col("question")).alias("tokens")), corpus, "qa_idx", "chunk_id")
        sparse = retrieval.sparse_ranks(scores, "qa_idx", "chunk_id", 3 * c.top_k)
        fused = retrieval.fuse(dense, sparse, "qa_idx", "chunk_id", c.dense_weight, c.sparse_weight, c.top_k, c.rrf_k)
        found = durable(retrieval.package(fused, corpus, "qa_idx", "chunk_id"), "retrieved")
        triples, failed = generation.answers(asked.drop("embedding"), found, "qa_idx", self.factory, self.policy)
        self._failed(result, "answer_generation", failed)
        result.tables["triples"] = durable(triples, "triples")
        return {"total_answers": result.tables["triples"].count(), "failed": failed.count()}

    def _quality_validation(self, _: DataFrame, result: RunResult) -> dict:
        c = self.config
        judged = generation.judge(result.tables["triples"], self.factory, self.policy)
        names = set(CRITERIA)
        score = F.when(F.col("validation_scores").isNotNull(), scoring.overall_score(F.col("validation_scores"), F.col("question_type"), names))
        judged = durable(judged.withColumn("quality_score", F.round(score, 6)), "judged")
        border = judged.where(scoring.verdict(F.col("quality_score"), c.quality_threshold) == "borderline").drop("validation_scores", "quality_score")
        again = generation.judge(border, self.factory, self.policy).withColumn("quality_score", F.round(score, 6))
        again = durable(again.select("qa_idx", "quality_score"), "again")
        final = durable(scoring.apply_retries(judged, again, "qa_idx", c.quality_threshold), "final")
        accepted = F.coalesce(F.col("quality_score"), F.lit(0.0)) >= c.quality_threshold
        result.tables |= {"validated": final.where(accepted), "rejected": final.where(~accepted), "criteria": scoring.criteria_averages(judged, "validation_scores", CRITERIA)}
        recovered = again.where(F.col("quality_score") >= c.quality_threshold)
        means = scoring.average_scores(judged, recovered).first().asDict()
        if c.enable_advanced_metrics and final.where(accepted).limit(1).count():
            chosen = scoring.exact_sample(final.where(accepted), "qa_idx", c.metric_sample_share).withColumn("triple_id", F.col("qa_idx"))
            noisy = scoring.bernoulli_sample(chosen, "qa_idx", c.noise_sample_rate, seed=2)
            other = result.tables["chunks"].agg(F.max_by("page_content", "chunk_id").alias("noise_chunk"))
            result.tables["metrics"] = generation.advanced_metrics(chosen, self.factory, self.policy, noisy.select("triple_id").crossJoin(F.broadcast(other)))
            result.tables["metric_summary"] = scoring.metric_summary(result.tables["metrics"], ["claim_faithfulness", "context_precision", "context_recall", "answer_relevancy"])
        rows = result.tables["validated"].withColumn("run_id", F.lit(result.run_id)).withColumn("triple_id", F.col("qa_idx"))
        result.tables["conversations"] = reporting.conversations(rows)
        return scoring.quality_report(final, c.quality_threshold).first().asDict() | means

    def _summary(self, documents: DataFrame, result: RunResult) -> DataFrame:
        rows = result.tables["validated"].unionByName(result.tables["rejected"]).withColumn("run_id", F.lit(result.run_id))
        names = documents.agg(F.count("*").alias("documents_processed"))
        chunks = result.tables["chunks"].agg(F.count("*").alias("total_chunks"))
        return reporting.run_summary(rows, self.config.quality_threshold).crossJoin(names).crossJoin(chunks)

    def describe(self) -> dict:
        """Configuration and stages, for a health or topology page."""
        return {"status": "healthy", "stages": stages(self.config), "settings": self.config.as_dict()}
