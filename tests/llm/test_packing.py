from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.packing import best_fit, combinations, nonnegative_counts, pack, packing_report, plan_containers, sized_documents


def test_combinations_are_all_of_them():
    got = {tuple(c) for c in combinations(12, np.arange(1, 13))}
    want = {(a, b, c) for a in range(1, 13) for b in range(0, a + 1) for c in range(0, b + 1) if a + b + c == 12}
    assert got == want


def test_least_squares_reaches_a_perfect_fit():
    combos = combinations(16, np.arange(1, 17))
    truth = np.zeros(len(combos))
    truth[[3, 20, 27]] = 50, 70, 90
    histogram = np.zeros(17)
    for c, n in zip(combos, truth):
        for v in c[c > 0]:
            histogram[v] += n
    x = nonnegative_counts(combos, histogram, np.ones(17))
    fitted = np.zeros(17)
    for c, n in zip(combos, x):
        for v in c[c > 0]:
            fitted[v] += n
    assert (x >= 0).all() and np.abs(fitted - histogram).max() < 0.5


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.lists(st.integers(1, 70), max_size=120))
def test_every_item_has_a_place_and_containers_hold(capacity, lengths):
    lengths = np.array([min(v, capacity) for v in lengths], np.int64)
    histogram = np.bincount(lengths, minlength=capacity + 1) if len(lengths) else np.zeros(capacity + 1, np.int64)
    plan = plan_containers(histogram, capacity)
    used, count = defaultdict(int), 0
    for length in range(1, capacity + 1):
        n = int(histogram[length])
        for c in plan.place(np.full(n, length), np.arange(n)) if n else ():
            used[int(c)] += length
            count += 1
    assert count == len(lengths) and all(v <= capacity for v in used.values())
    assert len(used) == plan.containers


def test_best_fit_uses_little_more_than_it_must():
    r = np.random.default_rng(2)
    histogram = np.bincount(r.integers(1, 257, 20_000), minlength=513)
    patterns = best_fit(histogram, 512)
    total = sum(n for _, n in patterns)
    assert total <= 1.02 * -(-int((histogram * np.arange(513)).sum()) // 512)


def test_large_capacity_is_measured_in_steps():
    r = np.random.default_rng(3)
    histogram = np.bincount(r.integers(1, 4096, 3_000), minlength=4097)
    plan = plan_containers(histogram, 4096)
    used = defaultdict(int)
    for length in np.flatnonzero(histogram):
        for c in plan.place(np.full(histogram[length], length), np.arange(histogram[length])):
            used[int(c)] += int(length)
    assert max(used.values()) <= 4096 and len(used) <= 1.08 * sum(used.values()) / 4096 + 1


def test_frame(spark):
    sizes = [5, 10, 3, 0, 25, 10, 7, 7, 7, 31, 1, 2, 20, 20]
    df = spark.createDataFrame([(k, n, "clash") for k, n in enumerate(sizes)], "doc_id long, n_tokens long, container string")
    assigned, _ = pack(df.select("doc_id", "n_tokens"), 10)
    rows = assigned.collect()
    per, used = defaultdict(list), defaultdict(int)
    for r in rows:
        per[r.doc_id].append(r)
        used[r.container] += r.n_tokens
    assert max(used.values()) <= 10
    for k, n in enumerate(sizes):
        got = sorted(per[k], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in got) == n
        assert [r.token_start for r in got] == [10 * i for i in range(len(got))]
        assert len(got) == -(-n // 10)
    report = packing_report(assigned, 10).first()
    assert report.n_tokens == sum(sizes) and report.n_containers <= report.fewest_possible + 1


def test_hot_length_and_empty(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "cast(4 as long) as n_tokens")
    report = packing_report(pack(df, 12)[0], 12).first()
    assert (report.n_items, report.n_containers) == (3000, 1000)
    assert pack(df.limit(0), 12)[0].count() == 0
    assert packing_report(pack(df.limit(0), 12)[0], 12).first().n_containers == 0
    with pytest.raises(ValueError):
        pack(df, 0)


def test_sizes_count_tokens_of_whole_texts(spark):
    rows = [(1, "Two words."), (1, "Two words."), (2, None), (3, ""), (4, "a_b c-d é"), (None, "x"), (5, "word " * 50_000), (6, "​")]
    got = {r.doc_id: r.n_tokens for r in sized_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 3, 2: 0, 3: 0, 4: 5, 5: 50_000, 6: 1}
