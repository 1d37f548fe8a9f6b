"""Queries that go through stores, caches, document files, logs and the progress of a run."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..logs import StageLog
from ..operators import retrieval
from ..operators.models import OfflineModel
from ..session import shared_dir
from ..sources.documents import ChunkCache, read_documents
from ..sources.stores import KeyedStore
from ..streaming import progress
from .catalogue import register, table
from .pipeline import ADMISSION, Pipeline, TooManyRuns, stages
from .text_queries import _CHUNKS, chunks

_RUN = "run_id string, status string, started_at timestamp, quality_threshold double"


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "run_history",
    """SELECT run_id, CASE WHEN quality_threshold > 0.7 THEN 'checked' ELSE coalesce(status, 'none') END AS status, epoch_us(started_at)::BIGINT AS started_us FROM pipeline_runs
    WHERE run_id <> (SELECT max(run_id) FROM pipeline_runs) ORDER BY started_at DESC NULLS LAST, run_id LIMIT 50""",
)
def run_history(spark, sf):
    """Runs recorded, some of them again with another status, one deleted; the newest fifty."""
    runs = table(spark, sf, "pipeline_runs").select("run_id", F.coalesce("status", F.lit("none")).alias("status"), "started_at", "quality_threshold")
    store = KeyedStore(spark, _place(spark, "runs"), _RUN, "run_id", "started_at")
    store.record(runs)
    store.record(runs.where("quality_threshold > 0.7").withColumn("status", F.lit("checked")))
    store.delete(runs.agg(F.max("run_id")).first()[0])
    return store.list(50).select("run_id", "status", F.unix_micros("started_at").alias("started_us"))


@register("run_of_store", "SELECT run_id, quality_threshold FROM pipeline_runs WHERE run_id = (SELECT min(run_id) FROM pipeline_runs)")
def run_of_store(spark, sf):
    runs = table(spark, sf, "pipeline_runs").select("run_id", "status", "started_at", "quality_threshold")
    store = KeyedStore(spark, _place(spark, "runs"), _RUN, "run_id", "started_at")
    store.record(runs)
    return store.get(runs.agg(F.min("run_id")).first()[0]).select("run_id", "quality_threshold")


@register(
    "chunk_cache",
    f"""WITH {_CHUNKS}, f AS (SELECT coalesce(source_file, 'none') AS source_file, count(*) AS n, sum(length(page_content))::BIGINT AS size FROM one GROUP BY 1)
    SELECT source_file, CASE WHEN sha256(source_file)[1:1] < '8' THEN n ELSE 0 END AS n_cached, CASE WHEN sha256(source_file)[1:1] < '8' THEN size ELSE 0 END AS size FROM f""",
)
def chunk_cache(spark, sf):
    """Chunks of some files are saved; asked for all files, the cache gives those and no others."""
    named = chunks(spark, sf).select(F.coalesce("source_file", F.lit("none")).alias("source_file"), "chunk_id", "page_content")
    named = named.withColumn("content_hash", F.sha2("source_file", 256))
    docs = named.select("source_file", "content_hash").distinct()
    cache = ChunkCache(spark, _place(spark, "cache"))
    cache.save(named.where(F.substring("content_hash", 1, 1) < "8"))
    held, missing = cache.split(docs)
    got = cache.load(held).groupBy("source_file").agg(F.count("*").alias("n_cached"), F.sum(F.length("page_content")).alias("size"))
    none = missing.select("source_file", F.lit(0).cast("long").alias("n_cached"), F.lit(0).cast("long").alias("size"))
    return got.unionByName(none)


@register("chunk_cache_cleared", "SELECT count(DISTINCT coalesce(source_file, 'none')) AS n_missing, 0::BIGINT AS n_held FROM chunks")
def chunk_cache_cleared(spark, sf):
    named = chunks(spark, sf).select(F.coalesce("source_file", F.lit("none")).alias("source_file"), "chunk_id").withColumn("content_hash", F.sha2("source_file", 256))
    cache = ChunkCache(spark, _place(spark, "cache"))
    cache.save(named)
    cache.clear()
    held, missing = cache.split(named.select("content_hash").distinct())
    return missing.agg(F.count("*").alias("n_missing")).crossJoin(held.agg(F.count("*").alias("n_held")))


_SAFE = "[^\\x20-\\x7e\\u00a1-\\ud7ff]"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(sections: list[tuple[str, str]]) -> bytes:
    """A document of headings and paragraphs, for reading back."""
    paragraph = lambda text, style: f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'
    body = "".join(paragraph(h, '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>') + paragraph(t, "") for h, t in sections)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{_W}"><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@register(
    "document_files",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[^\x20-\x7e\x{00a1}-\x{d7ff}]', '', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id || '.docx' AS source_file, 'No ' || doc_id || chr(10) || chr(10) || t AS raw_text, 1::INT AS n_headings, 'No ' || doc_id AS heading, CASE WHEN t = '' THEN false ELSE true END AS has_body FROM d WHERE t <> ''""",
)
def document_files(spark, sf):
    """Each document written as a file of its own in the shared folder, then read and parsed."""
    clean = F.trim(F.regexp_replace("text", _SAFE, ""))
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", clean.alias("text")).where("text <> ''")
    folder = _place(spark, "files")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [_docx([(f"No {i}", t)]) for i, t in zip(b["doc_id"], b["text"])]})

    packed = rows.mapInPandas(pack, "doc_id long, content binary")
    write_files(packed, folder)
    read = read_documents(spark, [folder]).where("error is null")
    return read.select("source_file", "raw_text", F.size("headings").alias("n_headings"), F.col("headings")[0]["heading_text"].alias("heading"), (F.length("raw_text") > 0).alias("has_body"))


def write_files(packed, folder: str) -> None:
    """``(doc_id, content)`` as files ``<doc_id>.docx``, written by the executors."""
    address = folder.removeprefix("file://").removeprefix("file:")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, path = (fs.LocalFileSystem(), address) if address.startswith("/") else fs.FileSystem.from_uri(address)
        where.create_dir(path, recursive=True)
        for b in batches:
            for i, content in zip(b["doc_id"], b["content"]):
                with where.open_output_stream(f"{path}/{i}.docx") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(b)]})

    packed.mapInPandas(write, "n long").agg(F.sum("n")).collect()


@register("stage_log", "SELECT * FROM (VALUES ('phase', 'reading', 1), ('step', 'count', 1), ('step', 'broken', 1)) AS v(kind, name, n)")
def stage_log(spark, sf):
    """Steps inside a phase, one of which fails, as rows of the log."""
    log = StageLog("reader")
    with log.phase("reading"):
        with log.step("count"):
            table(spark, sf, "nation").count()
        try:
            with log.step("broken"):
                raise ValueError("for the log")
        except ValueError:
            pass
    rows = spark.createDataFrame([(k, n, s) for k, n, s in log.timings], "kind string, name string, seconds double")
    return rows.where("seconds >= 0").groupBy("kind", "name").agg(F.count("*").cast("int").alias("n"))


_STAGES = stages(PipelineConfig())


@register("pipeline_stages", "SELECT * FROM (VALUES (1, 'semantic_chunking', 'healthy'), (2, 'knowledge_graph', 'healthy'), (3, 'question_generation', 'healthy'), (4, 'multihop_generator', 'healthy'), (5, 'deduplication', 'healthy'), (6, 'answer_generation', 'healthy'), (7, 'quality_validation', 'healthy')) AS v(no, stage, status)")
def pipeline_stages(spark, sf):
    """The stages of a run, as a health page shows them."""
    known = Pipeline(spark, OfflineModel).describe()
    return spark.createDataFrame([(k, s, known["status"]) for k, s in enumerate(known["stages"], 1)], "no int, stage string, status string")


@register(
    "progress_replayed",
    """SELECT * FROM (VALUES ('phase_start', 7), ('phase_complete', 7), ('log', 1), ('pipeline_complete', 1), ('stream_end', 1)) AS v(type, n)""",
)
def progress_replayed(spark, sf):
    """The events of a run, as they were written and as a replay finds them."""
    folder = _a_run(spark)
    return progress.replay(spark, folder).groupBy("type").agg(F.count("*").cast("int").alias("n"))


def _a_run(spark) -> str:
    folder = _place(spark, "progress")
    log = progress.ProgressLog(folder, "run-1", len(_STAGES), spark)
    log.log("begins")
    for k, name in enumerate(_STAGES, 1):
        log.phase_start(name, k)
        log.phase_complete(name, k, rows=k)
    log.complete(run_id="run-1")
    return folder


@register("progress_followed", "SELECT 'run-1' AS run_id, 'completed' AS status, 7 AS phases_completed, 100 AS progress_pct, 17::BIGINT AS n_events")
def progress_followed(spark, sf):
    """The state of a run, folded from the stream of its events."""
    folder, out = _a_run(spark), _place(spark, "state")
    states = progress.run_states(progress.follow(spark, folder))
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/result")
    states.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(states.schema).parquet(f"{out}/result")


@register("lines_delivered", "SELECT 17::BIGINT AS n_lines, 17::BIGINT AS n_ended, true AS in_order")
def lines_delivered(spark, sf):
    """What a client of the stream of a run is sent."""
    sent: list[str] = []
    progress.deliver(progress.follow(spark, _a_run(spark)), sent.append, _place(spark, "delivered")).awaitTermination()
    ended = sum(x.startswith("data: {") and x.endswith("}\n\n") for x in sent)
    return spark.createDataFrame([(len(sent), ended, "stream_end" in sent[-1] or "pipeline_complete" in sent[-1])], "n_lines long, n_ended long, in_order boolean")


@register("runs_admitted", "SELECT 3 AS admitted, true AS next_refused")
def runs_admitted(spark, sf):
    """Three runs work at a time; one more is refused before it reads anything."""
    held = 0
    while ADMISSION.acquire(blocking=False):
        held += 1
    try:
        try:
            Pipeline(spark, OfflineModel).run(table(spark, sf, "nation"))
            refused = False
        except TooManyRuns:
            refused = True
    finally:
        for _ in range(held):
            ADMISSION.release()
    return spark.createDataFrame([(held, refused)], "admitted int, next_refused boolean")


@register(
    "one_side_down",
    f"""WITH {_CHUNKS} SELECT chunk_id % 50 AS qid, chunk_id, (row_number() OVER (PARTITION BY chunk_id % 50 ORDER BY chunk_id))::INT AS rank, round(0.6 / (60 + row_number() OVER (PARTITION BY chunk_id % 50 ORDER BY chunk_id)), 6) AS rrf_score FROM one
    QUALIFY row_number() OVER (PARTITION BY chunk_id % 50 ORDER BY chunk_id) <= 5""",
)
def one_side_down(spark, sf):
    """Fusion when the inverted lists give nothing: the dense side alone ranks."""
    from pyspark.sql.window import Window

    ids = chunks(spark, sf).select((F.col("chunk_id") % 50).alias("qid"), "chunk_id")
    dense = ids.withColumn("dense_rank", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id"))).where("dense_rank <= 15")
    nothing = spark.createDataFrame([], "qid int, chunk_id int, sparse_rank int")
    return retrieval.fuse(dense, nothing, "qid", "chunk_id").select("qid", "chunk_id", "rank", "rrf_score")
