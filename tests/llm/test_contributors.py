import random

import pytest

from millrace.llm.contributors import cap_contributors, cutoff_split, fraction_cutoffs, keep_fraction, rank_split, scored_records

META = "id string, metadata struct<source_file string, quality_score double>, contributor string, score string"


def conversations(spark, rows):
    return spark.createDataFrame([(i, (f, s) if (f, s) != (0, 0) else None, "clash", "clash") for i, f, s in rows], META)


def brute(rows):
    by, seen = {}, {}
    for i, f, s in rows:
        if i is None or f is None or not f.strip() or s is None or s != s:
            continue
        name = f.replace("\\", "/").rsplit("/", 1)[-1].strip().lower()
        seen[i] = max(seen.get(i, (-9, "")), (s, name))
    for i, (s, name) in seen.items():
        by.setdefault(name, []).append((-s, i.encode(), i))
    return {k: sorted(v) for k, v in by.items()}


def sample_rows(n=600, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        f = r.choice(["Hot.docx", "a/hot.DOCX ", r"c:\x\hot.docx"] * 4 + ["b.pdf", "x/C.pdf", None, "  ", "d.md"])
        rows.append((f"r-{k % (n - 40)}", f, r.choice([round(r.random(), 1), None, float("nan"), 0.5])))
    return rows


@pytest.mark.parametrize("salts", [1, 7])
def test_cap_matches_brute_force(spark, salts):
    rows = sample_rows()
    records = scored_records(conversations(spark, rows))
    kept, gone = cap_contributors(records, max_count=5, salts=salts)
    want = brute(rows)
    assert {r.ident for r in gone.collect()} == {i for v in want.values() for _, _, i in v[5:]}
    assert {r.ident for r in kept.collect()} == {i for v in want.values() for _, _, i in v[:5]}


def test_share_cap_and_zero(spark):
    records = scored_records(conversations(spark, [(f"r{k}", "a", 0.1 * (k % 3)) for k in range(20)] + [("z", "b", 0.3)]))
    kept, gone = cap_contributors(records, max_permille=100)
    assert kept.count() == 3 and gone.count() == 18
    kept, gone = rank_split(records, 0)
    assert kept.count() == 0 and gone.count() == 21


@pytest.mark.parametrize("cap", [0, 1, 7, 100])
def test_large_caps_by_cutoffs(spark, cap):
    """One contributor holds two thirds; scores tie everywhere."""
    rows = sample_rows(500, 8) + [(f"t{k:04d}", "hot.docx", 0.5) for k in range(150)]
    records = scored_records(conversations(spark, rows))
    kept, gone = cutoff_split(records, cap, buckets=8)
    want = brute(rows)
    assert {r.ident for r in kept.collect()} == {i for v in want.values() for _, _, i in v[:cap]}
    assert {r.ident for r in gone.collect()} == {i for v in want.values() for _, _, i in v[cap:]}


def test_cutoffs_match_brute_force(spark):
    rows = sample_rows(seed=3)
    records = scored_records(conversations(spark, rows))
    got = {r.contributor: r for r in fraction_cutoffs(records).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for name, v in want.items():
        k = -(-2 * len(v) // 5)
        cut = -v[k - 1][0]
        assert (got[name].n_rows, got[name].n_target, got[name].cutoff) == (len(v), k, cut)
        assert got[name].n_kept == sum(-s >= cut for s, _, _ in v)
    kept = {r.ident for r in keep_fraction(records).collect()}
    assert kept == {i for name, v in want.items() for s, _, i in v if -s >= got[name].cutoff}


def test_ties_everywhere_and_full_fraction(spark):
    records = scored_records(conversations(spark, [(f"r{k:02d}", "a", 0.5) for k in range(30)]))
    row = fraction_cutoffs(records, 1, 10).first()
    assert (row.n_target, row.cutoff, row.n_kept) == (3, 0.5, 30)
    assert fraction_cutoffs(records, 1, 1).first().n_kept == 30
    with pytest.raises(ValueError):
        fraction_cutoffs(records, 3, 2)


def test_empty_and_all_null(spark):
    for rows in ([], [(None, "a", 0.1), ("x", None, 0.1), ("y", "a", None), ("z", 0, 0)]):
        records = scored_records(conversations(spark, rows))
        assert cap_contributors(records, 3)[1].count() == 0
        assert fraction_cutoffs(records).count() == 0
