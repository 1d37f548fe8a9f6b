"""From documents to chunks: sentences, boundaries, text, headings, ids, statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import split_sentences
from ..functions.vectors import mean_vectors
from .ordering import BUCKETS, running_total

_WORD = re.compile(r"\w+")
_SPAN = ["doc_chunk_id", "sentence_start", "sentence_end", "num_sentences", "char_length", "page_content"]


def sentences(docs: DataFrame, key: str, text: str, longer_than: int = 20) -> DataFrame:
    """``(key, sent_idx, sentence)``; documents without a usable sentence have no rows."""
    return docs.select(key, F.posexplode(split_sentences(F.col(text), longer_than)).alias("sent_idx", "sentence"))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of arrays, end to end, and where each row's begin and end; null is empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def _near(words: list[set[str]]) -> list[float]:
    """Word-set similarity of each sentence to the next, 6 decimals; 0 where one has no words."""
    out = []
    for x, y in zip(words, words[1:]):
        both = len(x & y)
        out.append(round(both / (len(x) + len(y) - both), 6) if both else 0.0)
    return out


def fold(lengths: list[int], similarities: list[float | None], threshold: float, least: int, most: int) -> list[tuple[int, int]]:
    """First and last sentence of each chunk of one document; see ``fold_chunks``."""
    out: list[tuple[int, int]] = []
    start, size, held = 0, lengths[0] if lengths else 0, bool(lengths)
    for i, (near, following) in enumerate(zip(similarities, lengths[1:])):
        if held and near is not None and near < threshold and size >= least:
            out.append((start, i))
            start, size = i + 1, following
            continue
        size, held = (size + 1 + following if held else following), True
        if size > most:
            out.append((start, i + 1))
            start, held = i + 2, False
    return [*out, (start, len(lengths) - 1)] if held else out


def fold_chunks(lengths: Column, similarities: Column, threshold: float = 0.75, least: int = 200, most: int = 3000) -> Column:
    """Spans of sentences that make up the chunks of one document, as ``array<struct<a, b>>``.

    Walks the sentences in order. A similarity under ``threshold`` ends a chunk that has at least
    ``least`` characters; otherwise the next sentence joins, and a chunk that grew over ``most``
    characters ends with it. Lengths count the single spaces between sentences. What is left at the
    end is a chunk of whatever length. No sentences give an empty array. A loop over sentences would
    run interpreted as an expression; it works on Arrow batches, where the document is.
    """

    @F.arrow_udf("array<struct<a:int,b:int>>")
    def spans(size: pa.Array, near: pa.Array) -> pa.Array:
        (sizes, se), (nears, ne) = _lists(size), _lists(near)
        sizes, nears = sizes.to_pylist(), nears.to_pylist()
        found, upto = [], [0]
        for a, b, c, d in zip(se, se[1:], ne, ne[1:]):
            found += fold(sizes[a:b], nears[c:d], threshold, least, most)
            upto.append(len(found))
        first, last = (pa.array([x[k] for x in found], pa.int32()) for k in (0, 1))
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([first, last], ["a", "b"]))

    return spans(lengths, similarities)


def chunk_documents(docs: DataFrame, key: str, text: str, threshold: float = 0.1, least: int = 200, most: int = 3000) -> DataFrame:
    """``(key, doc_chunk_id, sentence_start, sentence_end, num_sentences, char_length,
    page_content)`` with lexical similarity of neighbouring sentences as the break signal.

    A document is folded where it is read: no shuffle at all.
    """
    rows = docs.select(key, split_sentences(F.col(text)).alias("_s")).where(F.size("_s") > 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _lists(batch.column("_s"))
            said = values.to_pylist()
            words = [set(_WORD.findall(s.lower())) for s in said]
            found: list[tuple[int, int, int, int, int, int, str]] = []
            for row, (a, b) in enumerate(zip(ends, ends[1:])):
                for k, (first, last) in enumerate(fold([len(s) for s in said[a:b]], _near(words[a:b]), threshold, least, most)):
                    body = " ".join(said[a + first : a + last + 1])
                    found.append((row, k, first, last, last - first + 1, len(body), body))
            columns = list(zip(*found)) or [()] * 7
            numbers = [pa.array(c, pa.int32()) for c in columns[1:6]]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(columns[0], pa.int32())), *numbers, pa.array(columns[6], pa.string())], [key, *_SPAN])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(cut, f"{key} {kind}, " + ", ".join(f"{c} int" for c in _SPAN[:5]) + ", page_content string")


def materialise(spans: DataFrame, key: str) -> DataFrame:
    """Text and counts of chunks from their spans over the array ``_s``."""
    a, b = F.col("_c.a"), F.col("_c.b")
    body = F.array_join(F.slice("_s", a + 1, b - a + 1), " ")
    return spans.select(
        key, "doc_chunk_id", a.alias("sentence_start"), b.alias("sentence_end"), (b - a + 1).alias("num_sentences"),
        F.length(body).alias("char_length"), body.alias("page_content"),
    )


def chunk_by_vectors(sents: DataFrame, key: str, threshold: float = 0.75, least: int = 200, most: int = 3000) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``(key, sent_idx, sentence, embedding)`` with cosine as the break signal, and their
    embeddings: the unweighted, unnormalised mean of their sentences' vectors."""
    from ..functions.vectors import cosine

    packed = sents.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence", "embedding"))).alias("_p"))
    packed = packed.select(key, F.transform("_p", lambda p: p["sentence"]).alias("_s"), F.transform("_p", lambda p: p["embedding"]).alias("_v"))
    n = F.greatest(F.size("_v") - 1, F.lit(0))
    packed = packed.withColumn("_sim", F.zip_with(F.slice("_v", 1, n), F.slice("_v", 2, n), lambda x, y: F.round(cosine(x, y), 6)))
    spans = packed.select(key, "_s", "_v", F.posexplode(fold_chunks(F.transform("_s", lambda s: F.length(s)), F.col("_sim"), threshold, least, most)).alias("doc_chunk_id", "_c"))
    members = spans.select(key, "doc_chunk_id", F.explode(F.slice("_v", F.col("_c.a") + 1, F.col("_c.b") - F.col("_c.a") + 1)).alias("_e"))
    return materialise(spans, key), mean_vectors(members, [key, "doc_chunk_id"], "_e")


def markdown_headings(text: Column) -> Column:
    """Headings of a text as ``array<struct<char_offset, heading_text, heading_level>>``. Offsets are
    those of the lines, so a title that comes again elsewhere is no matter."""
    lines = F.split(text, "\n")
    at = lambda i: F.length(F.array_join(F.slice(lines, 1, i), "\n")) + F.when(i > 0, 1).otherwise(0)
    marked = F.filter(F.transform(lines, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda e: e["s"].rlike("^#{1,6} "))
    return F.transform(marked, lambda e: F.struct(at(e["i"]).alias("char_offset"), F.regexp_replace(e["s"], "^#+ ", "").alias("heading_text"), F.length(F.regexp_extract(e["s"], "^(#+)", 1)).alias("heading_level")))


def heading_paths(chunks: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Add ``heading_path`` and ``parent_section`` from the document's headings.

    A chunk lies where its first 100 characters are first found in ``raw_text``; not found, it has
    no path. Headings up to there are replayed: each sets its level and clears the deeper ones.
    """
    place = F.instr(F.col("raw_text"), F.substring("page_content", 1, 100)) - 1
    joined = chunks.join(docs.select(key, "raw_text", "headings"), key, "left").withColumn("_at", F.when(place >= 0, place))
    before = F.filter(F.col("headings"), lambda h: h["char_offset"] <= F.col("_at"))
    blank = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))

    def replay(m: Column, h: Column) -> Column:
        kept = F.map_filter(m, lambda k, _: k < h["heading_level"])
        return F.map_concat(kept, F.create_map(h["heading_level"].cast("int"), h["heading_text"]))

    found = F.aggregate(before, blank, replay)
    path = F.transform(F.array_sort(F.map_entries(found)), lambda e: e["value"])
    path = F.when(F.col("_at").isNotNull() & (F.size(path) > 0), path)
    out = joined.withColumn("heading_path", path).withColumn("parent_section", F.element_at("heading_path", -1))
    return out.drop("raw_text", "headings", "_at")


def global_ids(chunks: DataFrame, doc: str, order: str) -> DataFrame:
    """Dense ``chunk_id`` from 0 in (doc, order); ``doc`` is a number.

    Counts per document give each its offset. The prefix sum over documents runs in buckets of
    document numbers, so no task has all of them.
    """
    counts = chunks.groupBy(doc).agg(F.count("*").alias("_n"))
    bounds = counts.agg(F.min(doc).alias("_lo"), F.max(doc).alias("_hi"))
    bucket = F.floor((F.col(doc) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * BUCKETS).cast("int")
    counts = counts.crossJoin(F.broadcast(bounds)).select(doc, "_n", F.lit(0).alias("_all"), bucket.alias("_bucket"))
    offsets = running_total(counts, ["_all"], "_bucket", [F.col(doc)], "_n", "_upto").select(doc, (F.col("_upto") - F.col("_n")).alias("_off"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    return chunks.join(offsets, doc).withColumn("chunk_id", (F.col("_off") + place).cast("long")).drop("_off")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Count, and mean (rounded), smallest and largest size by the text itself."""
    size = F.length("page_content")
    return chunks.agg(F.count("*").alias("total_chunks"), F.round(F.avg(size), 0).alias("avg_chunk_size"), F.min(size).alias("min_chunk_size"), F.max(size).alias("max_chunk_size"))


def chunks_per_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_file").agg(F.count("*").alias("n_chunks"))


def split_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, failures) of a frame with an ``error`` column; refuses only if all failed."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null")
