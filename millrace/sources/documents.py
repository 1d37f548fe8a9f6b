"""Document files: finding, reading, hashing, taking in, and the cache of their chunks."""

from __future__ import annotations

import io
import re
import shutil
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".docx", ".pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "source_file string, content_hash string, raw_text string, headings array<struct<char_offset:int,heading_text:string,heading_level:int>>, error string"


def find_documents(folder: str, paths: list[str] | None = None) -> list[str]:
    """Paths to read: those given, which must exist, else the .docx and .pdf files of the folder,
    sorted. None at all is an error."""
    if paths:
        missing = [p for p in paths if not Path(p).is_file()]
        if missing:
            raise FileNotFoundError(", ".join(missing))
        return list(paths)
    found = sorted(str(p) for p in Path(folder).iterdir() if p.suffix.lower() in SUFFIXES)
    if not found:
        raise ValueError(f"no documents in {folder}")
    return found


def parse_docx(content: bytes) -> tuple[str, list[dict]]:
    """(text, headings): non-empty paragraphs, then table rows, joined by blank lines.

    A heading is a paragraph of style ``Heading N`` (level 1 where N can't be read). Cells of a row
    are joined by `` | ``.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""

    def text_of(node) -> str:
        out = []
        for n in node.iter():
            if n.tag == f"{_W}t":
                out.append(n.text or "")
            elif n.tag == f"{_W}tab":
                out.append("\t")
            elif n.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
        return "".join(out).strip()

    parts, headings, at = [], [], 0
    for p in body.findall(f"{_W}p"):
        text = text_of(p)
        if not text:
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = "" if style is None else names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) or ""
        if name.lower().startswith("heading"):
            level = re.search(r"(\d+)\s*$", name)
            headings.append({"char_offset": at, "heading_text": text, "heading_level": int(level.group(1)) if level else 1})
        parts.append(text)
        at += len(text) + 2
    for t in body.findall(f"{_W}tbl"):
        for r in t.iter(f"{_W}tr"):
            cells = [c for c in (text_of(c) for c in r.findall(f"{_W}tc")) if c]
            if cells:
                parts.append(" | ".join(cells))
    if not parts:
        raise ValueError("the document has no text")
    return "\n\n".join(parts), headings


def parse_pdf(content: bytes) -> tuple[str, list[dict]]:
    """Text of the pages that have any, joined by blank lines; needs the optional ``fitz``."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package pymupdf") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        pages = [p.get_text().strip() for p in doc]
    pages = [p for p in pages if p]
    if not pages:
        raise ValueError("the document has no text")
    return "\n\n".join(pages), []


PARSERS = {".docx": parse_docx, ".pdf": parse_pdf}


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(source_file, content_hash, raw_text, headings, error)``, a row per file.

    Files are read and parsed by the executors. A file that can't be parsed is a row with an error.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content", F.sha2("content", 256).alias("content_hash"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, digest in zip(b["path"], b["content"], b["content_hash"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    parser = PARSERS.get(Path(name).suffix.lower())
                    if parser is None:
                        raise ValueError(f"unsupported file type: {name}")
                    text, headings = parser(bytes(content))
                    rows.append((name, digest, text, headings, None))
                except Exception as e:
                    rows.append((name, digest, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["source_file", "content_hash", "raw_text", "headings", "error"])

    return files.mapInPandas(parse, SCHEMA)


def take_in(paths: list[str], folder: str, max_mb: float = 50) -> list[str]:
    """Copy files into the folder after checking all of them: type by suffix, size, plain names."""
    for p in map(Path, paths):
        if p.suffix.lower() not in SUFFIXES:
            raise ValueError(f"unsupported file type: {p.name}")
        if p.stat().st_size > max_mb * 1024 * 1024:
            raise ValueError(f"{p.name} is larger than {max_mb} MB")
    Path(folder).mkdir(parents=True, exist_ok=True)
    return [shutil.copy(p, Path(folder) / Path(p).name) for p in paths]


class ChunkCache:
    """Chunks with embeddings by content hash, as parquet partitions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def split(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents in the cache, documents that are not); unreadable means not."""
        if not self._exists():
            return docs.limit(0), docs
        held = self.spark.read.parquet(self.path).select("content_hash").distinct()
        return docs.join(held, "content_hash", "left_semi"), docs.join(held, "content_hash", "left_anti")

    def load(self, docs: DataFrame) -> DataFrame:
        """Cached chunks of the documents, under their present names and numbers."""
        now = docs.select("content_hash", *(c for c in ("source_file", "doc_index") if c in docs.columns))
        held = self.spark.read.parquet(self.path).drop("source_file", "doc_index")
        return held.join(now, "content_hash")

    def save(self, chunks: DataFrame) -> None:
        """Write chunks (with ``content_hash``); partitions of other documents stay."""
        chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("content_hash").parquet(self.path)

    def clear(self) -> bool:
        """Remove the cache; whether there was one."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return bool(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
