"""Problem 4: splitting oversized items at natural boundaries, with balanced targets."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A natural boundary: a line break with the white space around it, or white space after . ! ?
_EDGE = re.compile(r"\s*[\n\r]\s*|(?<=[.!?])\s+")
_BLANK = re.compile(r"[\n\r]\s*[\n\r]")
_HEADING = re.compile(r"#{1,6}\s|\d+[.)]\s|[-*•]\s")
#: Strengths of boundaries; 0 and 1 are forced cuts (between characters, between words).
CHARACTER, WORD, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    kind: str  # how it ends: natural, forced, or end (of the text)


def boundaries(text: str, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """Positions where a piece may end, ascending, and their strengths.

    White space at a boundary goes to the piece before it as far as the limit allows, so both its
    ends are positions. A stretch longer than the limit gets forced positions: evenly spaced, moved
    back to white space within a tenth of the spacing where there is any.
    """
    spans: list[tuple[int, int, int]] = []
    for m in _EDGE.finditer(text):
        if m.start() == 0 or m.end() == len(text):
            continue
        if "\n" in m.group() or "\r" in m.group():
            kind = PARAGRAPH if _BLANK.search(m.group()) or _HEADING.match(text, m.end()) else LINE
        else:
            kind = SENTENCE
        spans.append((m.start(), m.end(), kind))
    at: dict[int, int] = {}
    before = 0
    for start, end, kind in [*spans, (len(text), len(text), PARAGRAPH)]:
        if start - before > limit:
            room = max(1, limit - overlap)
            parts = -(-(start - before) // room)
            for i in range(1, parts):
                want = before + (start - before) * i // parts
                reach = max(1, room // 10)
                low = max(before, want - reach)
                back = max((k for k in range(want, low, -1) if text[k - 1].isspace()), default=0)
                at[back or want] = WORD if back else CHARACTER
        if end < len(text):
            if start < end:
                at[start] = max(at.get(start, 0), kind)
            at[end] = kind
        before = end
    cuts = sorted(at)
    return cuts, [at[c] for c in cuts]


def split_text(text: str, limit: int = 3000, overlap: int = 200, reach: float = 0.25) -> list[Piece]:
    """Pieces of at most ``limit`` characters that cover ``text`` in order.

    Each piece but the first starts ``overlap`` characters before the end of the one before; where
    the limit leaves no room for that (a stretch without a boundary nearly as long as the limit)
    the overlap shrinks rather than cutting at an unnatural place. A forced cut is made only inside
    a stretch between natural boundaries that is itself over the limit.

    Method: the smallest possible number of pieces gives equally spaced targets; each is snapped to
    the strongest boundary within ``reach`` of a piece's length, the nearest of these first; when a
    piece comes out over the limit another piece is added, and at last the cuts are taken greedily.
    """
    if limit < 2 or not 0 <= overlap < limit:
        raise ValueError("need 0 <= overlap < limit and limit >= 2")
    n = len(text)
    if n <= limit:
        return [Piece(0, n, "end")] if n else []
    cuts, strength = boundaries(text, limit, overlap)
    least = max(2, -(-(n - overlap) // (limit - overlap)))
    chosen: list[int] | None = None
    for count in range(least, min(2 * least + 2, len(cuts) + 1) + 1):
        chosen = _snap(cuts, strength, n, count, limit, overlap, reach)
        if chosen:
            break
    if not chosen:
        chosen = _greedy(cuts, n, limit, overlap)
    kinds = dict(zip(cuts, strength))
    pieces, start = [], 0
    for end in [*chosen, n]:
        pieces.append(Piece(start, end, "end" if end == n else "natural" if kinds[end] >= SENTENCE else "forced"))
        after = next((e for e in [*chosen, n] if e > end), n)
        start = max(end - overlap, after - limit, pieces[-1].start + 1)
    return pieces


def _snap(cuts: list[int], strength: list[int], n: int, count: int, limit: int, overlap: int, reach: float) -> list[int] | None:
    picked: list[int] = []
    last = 0
    for i in range(1, count):
        target = n * i / count
        width = reach * n / count
        latest = limit if last == 0 else last - overlap + limit
        low = bisect_right(cuts, max(last, target - width))
        high = bisect_right(cuts, min(latest, target + width))
        if low >= high:
            return None
        best = max(range(low, high), key=lambda k: (strength[k], -abs(cuts[k] - target)))
        picked.append(cuts[best])
        last = cuts[best]
    return picked if n - (last - overlap) <= limit else None


def _greedy(cuts: list[int], n: int, limit: int, overlap: int) -> list[int]:
    """Furthest boundary that leaves room for the overlap, again and again; where there is none, the
    furthest within the limit, and the overlap takes what room is left."""
    picked, last = [], 0
    while True:
        room = limit - overlap if last else limit
        if n - last <= room:
            return picked
        k = bisect_right(cuts, last + room) - 1
        if k < 0 or cuts[k] <= last:
            if n - last <= limit:
                return picked
            k = bisect_right(cuts, last + limit) - 1
        if k < 0 or cuts[k] <= last:
            k = bisect_left(cuts, last + 1)
        picked.append(cuts[k])
        last = cuts[k]


def split_items(items: DataFrame, ident: str = "chunk_id", text: str = "page_content", limit: int = 3000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """``(chunk_id, piece, start, end, kind[, text])`` of every item over ``limit`` characters.

    Texts are cut where they are read, and only those over the limit (counted in characters from
    the text itself, whatever a length column says) reach Python. Null and short texts, and rows
    without an id, have no pieces. Where rows repeat an id, the pieces of its longest text come
    out, once (of equally long texts that with the greatest hash).
    """
    long = items.select(F.col(ident).alias("chunk_id"), F.col(text).alias("page_content")).where(F.col("chunk_id").isNotNull() & (F.length("page_content") > limit))
    id_type = long.schema["chunk_id"].dataType.simpleString()
    fields = "start:int,end:int,kind:string" + (",text:string" if with_text else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                [{"start": p.start, "end": p.end, "kind": p.kind} | ({"text": t[p.start : p.end]} if with_text else {}) for p in split_text(t, limit, overlap)]
                for t in b["page_content"]
            ]
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "_v": b["_v"], "_h": b["_h"], "pieces": rows})

    sized = long.withColumn("_v", F.length("page_content")).withColumn("_h", F.xxhash64("page_content"))
    done = sized.mapInPandas(cut, f"chunk_id {id_type}, _v int, _h long, pieces array<struct<{fields}>>")
    best = done.groupBy("chunk_id").agg(F.max_by("pieces", F.struct("_v", "_h")).alias("pieces"))
    return best.select("chunk_id", F.posexplode("pieces").alias("piece", "_p")).select("chunk_id", "piece", "_p.*")


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """Per split item: ``forced`` if any of its pieces ends at a forced cut, else ``natural``."""
    forced = F.max(F.when(F.col("kind") == "forced", 1).otherwise(0))
    return pieces.groupBy("chunk_id").agg(forced.alias("_f")).select("chunk_id", F.when(F.col("_f") == 1, "forced").otherwise("natural").alias("cut"))
