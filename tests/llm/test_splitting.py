import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.splitting import boundaries, cut_kinds, split_items, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    if not text:
        assert pieces == []
        return pieces
    assert pieces[0].start == 0 and pieces[-1].end == len(text) and pieces[-1].kind == "end"
    for p in pieces:
        assert 0 < p.end - p.start <= limit
    for a, b in zip(pieces, pieces[1:]):
        assert a.start < b.start <= a.end < b.end and a.end - b.start <= overlap
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_pieces_cover_under_the_limit(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_unless_a_stretch_is_too_long():
    r = random.Random(5)
    for _ in range(300):
        text = "".join("w" * r.randint(1, 90) + r.choice([". ", "! ", "\n", "\n\n", " ", "? "]) for _ in range(r.randint(5, 80)))
        pieces = check(text, 120, 20)
        widest = max(len(s) for s in re.split(r"\s*[\n\r]\s*|(?<=[.!?])\s+", text))
        if len(text) > 120:
            assert any(p.kind == "forced" for p in pieces) == (widest > 120)


def test_balanced_and_exact_overlap():
    text = "One sentence of some words. " * 400
    pieces = check(text, 3000, 200)
    sizes = [p.end - p.start for p in pieces]
    assert len(pieces) == -(-(len(text) - 200) // 2800) and max(sizes) - min(sizes) < 400
    assert {a.end - b.start for a, b in zip(pieces, pieces[1:])} == {200}


def exact_where_possible(text, limit, overlap):
    pieces = check(text, limit, overlap)
    ends = [*boundaries(text, limit, overlap)[0], len(text)]
    for a, b in zip(pieces, pieces[1:]):
        if a.end - b.start < overlap and b.start > a.start + 1:
            assert not any(a.end < e <= a.end - overlap + limit for e in ends)
    return pieces


def test_overlap_shrinks_only_without_a_boundary():
    sentence = "s" * 98 + ". "
    text = sentence * 10 + "x" * 5000 + ". " + sentence * 20
    pieces = exact_where_possible(text, 3000, 200)
    assert {a.end - b.start for a, b in zip(pieces, pieces[1:])} == {200}
    r = random.Random(11)
    for _ in range(300):
        text = "".join("w" * r.choice([r.randint(1, 30), r.randint(90, 400)]) + r.choice([". ", "\n", "! "]) for _ in range(r.randint(3, 40)))
        exact_where_possible(text, 120, 20)


def test_stronger_boundaries_win():
    text = "a b. " * 300 + "\n\n" + "a b. " * 300
    pieces = split_text(text, 2000, 100)
    assert 1502 in [p.end for p in pieces]


def test_very_long_text_without_boundaries():
    pieces = check("x" * 200_000, 3000, 200)
    assert all(p.kind in ("forced", "end") for p in pieces)


def test_frame(spark):
    long = "A few words here. " * 300
    rows = [(1, long, "x"), (1, long, "y"), (2, None, "z"), (3, "", "z"), (4, "y" * 7000, "z"), (None, long, "z"), (5, "short", "z"), (6, "x" * 3000, "z"), (1, "preview", "z")]
    df = spark.createDataFrame(rows, "chunk_id int, page_content string, text string")
    pieces = split_items(df)
    got = {}
    for r in pieces.collect():
        got.setdefault(r.chunk_id, []).append((r.piece, r.start, r.end, r.text))
    assert set(got) == {1, 4}
    body = sorted(got[1])
    assert "".join(t[(0 if k == 0 else body[k - 1][2] - s):] for k, (_, s, _, t) in enumerate(body)) == long
    assert {(r.chunk_id, r.cut) for r in cut_kinds(split_items(df, with_text=False)).collect()} == {(1, "natural"), (4, "forced")}
    assert split_items(df.limit(0)).count() == 0
