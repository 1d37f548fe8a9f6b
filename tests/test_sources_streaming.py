import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import documents as D
from millrace.streaming import progress as P

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(path, paragraphs, rows=()):
    p = "".join(f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for t, s in paragraphs)
    t = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>" if rows else ""
    styles = "".join(f'<w:style w:styleId="H{n}"><w:name w:val="heading {n}"/></w:style>' for n in (1, 2)) + '<w:style w:styleId="HX"><w:name w:val="Heading odd"/></w:style>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{t}{p}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}">{styles}</w:styles>')
    return str(path)


def test_docx_and_failures(spark, tmp_path):
    good = docx(tmp_path / "b.docx", [("Title", "H1"), ("  ", ""), ("Body text.", ""), ("Part", "H2"), ("Odd", "HX")], [("a", "", "b"), ("", "")])
    empty = docx(tmp_path / "a.docx", [])
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    assert [p.rsplit("/", 1)[1] for p in D.find_documents(str(tmp_path))] == ["a.docx", "b.docx", "c.pdf", "d.docx"]
    rows = {r.source_file: r for r in D.read_documents(spark, D.find_documents(str(tmp_path))).collect()}
    b = rows["b.docx"]
    assert b.error is None and b.raw_text == "Title\n\nBody text.\n\nPart\n\nOdd\n\na | b" and len(b.content_hash) == 64
    assert [(h.char_offset, h.heading_text, h.heading_level) for h in b.headings] == [(0, "Title", 1), (b.raw_text.index("Part"), "Part", 2), (b.raw_text.index("Odd"), "Odd", 1)]
    assert all(rows[k].error and rows[k].raw_text is None for k in ("a.docx", "c.pdf", "d.docx"))
    assert D.find_documents(str(tmp_path), [good, empty]) == [good, empty]
    with pytest.raises(FileNotFoundError):
        D.find_documents(str(tmp_path), ["/none.docx"])
    (tmp_path / "void").mkdir()
    with pytest.raises(ValueError):
        D.find_documents(str(tmp_path / "void"))


def test_take_in_checks_all_first(tmp_path):
    ok, bad = tmp_path / "a.pdf", tmp_path / "b.exe"
    ok.write_bytes(b"x")
    bad.write_bytes(b"x")
    with pytest.raises(ValueError):
        D.take_in([str(ok), str(bad)], str(tmp_path / "in"))
    assert not (tmp_path / "in").exists()
    assert D.take_in([str(ok)], str(tmp_path / "in"))
    with pytest.raises(ValueError):
        D.take_in([str(ok)], str(tmp_path / "in"), max_mb=0)


def test_chunk_cache(spark, tmp_path):
    cache = D.ChunkCache(spark, str(tmp_path / "cache"))
    docs = spark.createDataFrame([("h1", "new.docx", 7), ("h2", "two.docx", 8)], "content_hash string, source_file string, doc_index int")
    assert cache.split(docs)[1].count() == 2 and not cache.clear()
    cache.save(spark.createDataFrame([("h1", "old.docx", 0, "text")], "content_hash string, source_file string, doc_index int, page_content string"))
    hit, miss = cache.split(docs)
    assert [r.content_hash for r in hit.collect()] == ["h1"] and [r.content_hash for r in miss.collect()] == ["h2"]
    row = cache.load(hit).first()
    assert (row.source_file, row.doc_index, row.page_content) == ("new.docx", 7, "text")
    cache.save(spark.createDataFrame([("h2", "t", 0, "more")], "content_hash string, source_file string, doc_index int, page_content string"))
    assert cache.split(docs)[0].count() == 2 and cache.clear() and cache.split(docs)[0].count() == 0


def write_runs(folder):
    a, b = P.ProgressLog(folder, "a", 2), P.ProgressLog(folder, "b", 4)
    a.log("hello")
    a.phase_start("one", 1)
    a.phase_complete("one", 1, n=3)
    b.phase_start("one", 1)
    b.fail("boom")
    a.phase_complete("two", 2)
    a.complete(total=5)
    P.ProgressLog(folder, "c").log("waiting")
    with pytest.raises(ValueError):
        a.emit("nonsense")


def test_states_of_batch_and_stream_agree(spark, tmp_path):
    folder = str(tmp_path / "events")
    write_runs(folder)
    want = {r.run_id: (r.status, r.phases_completed, r.progress_pct) for r in P.run_states(P.replay(spark, folder)).collect()}
    assert want == {"a": ("completed", 2, 100), "b": ("failed", 0, 0), "c": ("pending", 0, 0)}
    q = P.run_states(P.follow(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.run_id: (r.status, r.phases_completed, r.progress_pct) for r in spark.table("states").collect()} == want


def test_lines_are_delivered_once_in_order(spark, tmp_path):
    folder, got = str(tmp_path / "events"), []
    write_runs(folder)
    for _ in range(2):
        P.deliver(P.follow(spark, folder), got.append, str(tmp_path / "check")).awaitTermination()
    assert len(got) == P.replay(spark, folder).count() and all(x.startswith("data: {") and x.endswith("\n\n") for x in got)
    mine = [json.loads(x[6:])["type"] for x in got if json.loads(x[6:])["run_id"] == "a"]
    assert mine == ["log", "phase_start", "phase_complete", "phase_complete", "pipeline_complete", "stream_end"]
    P.ProgressLog(folder, "d").log("later")
    P.deliver(P.follow(spark, folder), got.append, str(tmp_path / "check")).awaitTermination()
    assert json.loads(got[-1][6:])["run_id"] == "d"


def test_windows_of_batch_and_stream_agree(spark, tmp_path):
    rows = spark.range(500).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 97).alias("ts"), (F.col("id") % 3).cast("string").alias("k"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in P.event_windows(rows, "ts", "1 hour", "2 hours", "k").collect()}
    stream = P.event_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 hour", "2 hours", "k")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").collect()} == want


def test_logs_time_their_phases():
    from millrace.logs import StageLog, logged, setup_logging

    assert setup_logging() is setup_logging() and len(setup_logging().handlers) == 1
    log = StageLog("chunker")
    with log.phase("all"), log.step("one"):
        log.say("at work")
    with pytest.raises(KeyError), log.step("two"):
        raise KeyError("x")
    assert [(k, n) for k, n, _ in log.timings] == [("step", "one"), ("phase", "all"), ("step", "two")] and log.at == "-"
    assert logged("agent")(lambda x: x + 1)(2) == 3
