import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking


def model(lengths, sims, threshold, least, most):
    """A plain walk over the sentences."""
    if not lengths:
        return []
    spans, held, start = [], [0], 0
    size = lambda idx: sum(lengths[i] for i in idx) + len(idx) - 1
    for i in range(len(lengths) - 1):
        if held and sims[i] < threshold and size(held) >= least:
            spans.append((start, i))
            held, start = [i + 1], i + 1
        else:
            held.append(i + 1)
            if size(held) > most:
                spans.append((start, i + 1))
                held, start = [], i + 2
    return spans + ([(start, len(lengths) - 1)] if held else [])


def fold(spark, docs, *args):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(docs)], "k int, a array<int>, s array<double>")
    rows = df.select("k", chunking.fold_chunks(F.col("a"), F.col("s"), *args).alias("c")).orderBy("k").collect()
    return [[(x.a, x.b) for x in r.c] for r in rows]


def test_fold_against_a_plain_walk(spark):
    r = random.Random(7)
    docs = []
    for _ in range(300):
        n = r.randint(1, 40)
        docs.append(([r.randint(21, 900) for _ in range(n)], [r.choice([0.1, 0.74, 0.75, 0.9]) for _ in range(n - 1)]))
    assert fold(spark, docs, 0.75, 200, 3000) == [model(a, s, 0.75, 200, 3000) for a, s in docs]


def test_fold_edges(spark):
    docs = [([50], []), ([199, 30], [0.0]), ([200, 30], [0.0]), ([300, 30], [0.75]), ([1500, 1499], [0.9]), ([1500, 1500], [0.9]), ([1500, 1500, 40], [0.9, 0.9]), ([], [])]
    assert fold(spark, docs, 0.75, 200, 3000) == [[(0, 0)], [(0, 1)], [(0, 0), (1, 1)], [(0, 1)], [(0, 1)], [(0, 1)], [(0, 1), (2, 2)], []]


def test_chunks_tile_their_sentences(spark):
    text = " ".join(f"Sentence number {k} of this document is here." for k in range(60))
    docs = spark.createDataFrame([(0, text), (1, None), (2, ""), (3, "short")], "doc int, text string")
    rows = chunking.chunk_documents(docs, "doc", "text", 0.99).orderBy("doc_chunk_id").collect()
    assert {r.doc for r in rows} == {0}
    assert rows[0].sentence_start == 0 and rows[-1].sentence_end == 59
    assert all(b.sentence_start == a.sentence_end + 1 for a, b in zip(rows, rows[1:]))
    assert " ".join(r.page_content for r in rows) == text and all(r.char_length == len(r.page_content) for r in rows)


def test_vector_chunks_and_means(spark):
    rows = [(0, i, "x" * 150, [1.0, 0.0] if i < 2 else [0.0, 1.0]) for i in range(4)] + [(1, 0, "y" * 30, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "doc int, sent_idx int, sentence string, embedding array<double>")
    made, means = chunking.chunk_by_vectors(df, "doc")
    assert {(r.doc, r.sentence_start, r.sentence_end) for r in made.collect()} == {(0, 0, 1), (0, 2, 3), (1, 0, 0)}
    assert {(r.doc, r.doc_chunk_id): r.embedding for r in means.collect()} == {(0, 0): [1.0, 0.0], (0, 1): [0.0, 1.0], (1, 0): [0.0, 0.0]}


def test_headings(spark):
    raw = "One\nfirst text body\nTwo\nsecond text body\nThree\nthird text body\nFour\nlast text body"
    heads = [(0, "One", 1), (20, "Two", 2), (41, "Three", 3), (62, "Four", 2)]
    docs = spark.createDataFrame([(0, raw, heads)], "doc int, raw_text string, headings array<struct<char_offset:int,heading_text:string,heading_level:int>>")
    chunks = spark.createDataFrame([(0, "first text"), (0, "third text"), (0, "last text"), (0, "absent"), (9, "first text")], "doc int, page_content string")
    got = {(r.doc, r.page_content): (r.heading_path, r.parent_section) for r in chunking.heading_paths(chunks, docs, "doc").collect()}
    assert got[0, "first text"] == (["One"], "One") and got[0, "third text"] == (["One", "Two", "Three"], "Three")
    assert got[0, "last text"] == (["One", "Four"], "Four") and got[0, "absent"] == (None, None) and got[9, "first text"] == (None, None)


def test_global_ids_and_failures(spark):
    df = spark.createDataFrame([(2, 0), (0, 1), (0, 0), (7, 0)], "doc int, k int")
    assert {(r.doc, r.k): r.chunk_id for r in chunking.global_ids(df, "doc", "k").collect()} == {(0, 0): 0, (0, 1): 1, (2, 0): 2, (7, 0): 3}
    good, bad = chunking.split_failures(spark.createDataFrame([(1, None), (2, "boom")], "k int, error string"))
    assert good.columns == ["k"] and [r.error for r in bad.collect()] == ["boom"]


@pytest.mark.parametrize("name", ["chunk_documents"])
def test_no_shuffle(spark, name):
    docs = spark.createDataFrame([(0, "text")], "doc int, text string")
    plan = chunking.chunk_documents(docs, "doc", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan and plan.count("MapInArrow") == 1
