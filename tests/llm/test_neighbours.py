import numpy as np
import pytest

from millrace.llm.neighbours import IndexParameters, Pivots, all_neighbours, footrule_closeness, similar_pairs, with_orders

SCHEMA = "chunk_id int, embedding array<float>, similarity string, rank string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "clash", "clash") for k, v in vectors], SCHEMA)


def brute(vectors, k=10, least=-1.0):
    ids = sorted({i for i, _ in vectors})
    v = dict(vectors)
    u = np.array([v[i] for i in ids], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    out = {}
    for a in range(len(ids)):
        best = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out[ids[a]] = [(i, -x) for x, i in best if -x >= least]
    return out


def clustered(n, clusters, spread, seed=0, dim=64):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(clusters, dim))
    return [(k, centre[k % clusters] + spread * r.normal(size=dim)) for k in range(n)]


def test_footrule_is_that_of_the_definition():
    r = np.random.default_rng(1)
    orders = np.stack([r.permutation(30)[:8] for _ in range(40)]).astype(np.int32)
    close = footrule_closeness(orders, orders)
    other = footrule_closeness(orders[:7], orders)

    def distance(a, b):
        place = lambda o, p: list(o).index(p) if p in o else 8
        return sum(abs(place(a, p) - place(b, p)) for p in set(a) | set(b))

    for i in range(40):
        for j in range(40):
            if i != j:
                assert distance(orders[i], orders[j]) == 8 * 9 - 2 * close[i, j]
            if i < 7:
                assert 8 * 9 - 2 * other[i, j] == distance(orders[i], orders[j])


def test_nearest_pivots_in_order():
    r = np.random.default_rng(2)
    u, p = r.normal(size=(50, 16)).astype(np.float32), r.normal(size=(20, 16)).astype(np.float32)
    held = Pivots.of(p[:3], p)
    want = np.argsort(-(u @ held.pivots.T), axis=1, kind="stable")[:, :5]
    assert (held.orders(u, 3, 5) == want).all()
    few = held.orders(u, 3, 24)
    assert (np.sort(few[:, :20], 1) == np.arange(20)).all() and (few[:, 20:] == [-21, -22, -23, -24]).all()
    part = held.orders(u, 1, 5)
    home = np.argmax(u @ p[:3].T, 1)
    assert all(held.starts[g] <= x < held.starts[g + 1] for g, row in zip(home, part) for x in row if x >= 0)


def test_orders_by_regions_joined_or_broadcast(spark):
    """Beyond the bound of the broadcast, orders come from a join and are the same lists of pivots."""
    import pyspark.sql.functions as F

    vectors = frame(spark, clustered(600, 30, 0.3, 9)).select("chunk_id", "embedding")
    p = dict(vectors_per_pivot=10, region=12, looked=2, prefix=6)
    sides = []
    for bound in (1000, 10):
        rows = with_orders(vectors, 600, IndexParameters(broadcast_pivots=bound, **p)).select("chunk_id", F.filter("places", lambda x: x >= 0).alias("o")).collect()
        assert len(rows) == 600
        sides.append({r.chunk_id: r.o for r in rows})
    names = {}
    for i, order in sides[0].items():
        assert len(order) == len(sides[1][i])
        for x, y in zip(order, sides[1][i]):
            assert names.setdefault(x, y) == y
    got = all_neighbours(vectors, IndexParameters(broadcast_pivots=10, **p))
    assert got.count() == 6000


@pytest.mark.parametrize("block", [4096, 60])
def test_recall_against_brute_force(spark, block):
    vectors = clustered(1500, 60, 0.35)
    got = {}
    for r in all_neighbours(frame(spark, vectors), IndexParameters(min_similarity=0.82, block=block)).collect():
        got.setdefault(r.chunk_id, []).append((r.neighbour, r.similarity, r["rank"]))
    want = brute(vectors, 10, 0.82)
    hits = total = 0
    for i, best in want.items():
        mine = {n for n, _, _ in got.get(i, [])}
        total += len(best)
        hits += sum(n in mine for n, _ in best)
    assert total > 5000 and hits / total >= 0.97
    for found in got.values():
        found.sort(key=lambda x: x[2])
        assert [x[2] for x in found] == list(range(1, len(found) + 1)) and len(found) <= 10
        assert [(-s, n) for n, s, _ in found] == sorted((-s, n) for n, s, _ in found)


def test_small_sets_are_exact(spark):
    vectors = clustered(40, 8, 0.5, 3)
    got = {}
    for r in all_neighbours(frame(spark, vectors)).collect():
        got.setdefault(r.chunk_id, []).append((r["rank"], r.neighbour, r.similarity))
    want = brute(vectors)
    for i, best in want.items():
        assert [(n, pytest.approx(s, abs=2e-6)) for _, n, s in sorted(got[i])] == best


def test_copies_a_third_of_all(spark):
    base = clustered(200, 50, 0.4, 5)
    same = [(1000 + k, base[0][1] * (1 + k % 3)) for k in range(100)]
    vectors = base + same
    got = {}
    for r in all_neighbours(frame(spark, vectors)).collect():
        got.setdefault(r.chunk_id, []).append((r["rank"], r.neighbour, r.similarity))
    for k in range(100):
        mine = [n for _, n, s in sorted(got[1000 + k])]
        assert mine == [i for i in [0, *range(1000, 1011)] if i != 1000 + k][:10]
        assert all(s == 1.0 for _, _, s in got[1000 + k])
    assert [n for _, n, _ in sorted(got[0])] == list(range(1000, 1010))
    want = brute(vectors)
    assert np.mean([len({n for _, n, _ in got[i]} & {n for n, _ in want[i]}) / 10 for i, _ in base]) > 0.9


def test_unusable_vectors_repeats_and_extremes(spark):
    good = clustered(30, 3, 0.2, 7)
    bad = [(100, None), (101, [0.0] * 64), (102, [float("nan")] + [1.0] * 63), (103, [1.0] * 48), (104, [None] + [1.0] * 63), (105, []), (106, [float("inf")] + [1.0] * 63), (None, [1.0] * 64)]
    scaled = [(200, good[0][1] * 1e30), (201, good[0][1] * 1e-30)]
    pairs = {(r.chunk_a, r.chunk_b) for r in similar_pairs(all_neighbours(frame(spark, good + bad + scaled + good), IndexParameters(min_similarity=0.82))).collect()}
    assert all(a < b for a, b in pairs) and {i for p in pairs for i in p} <= {i for i, _ in good} | {200, 201}
    assert (200, 201) in pairs and (0, 200) in pairs


def test_empty_and_single(spark):
    assert all_neighbours(frame(spark, [])).count() == 0
    assert all_neighbours(frame(spark, [(1, [1.0] * 64)])).count() == 0
    assert all_neighbours(frame(spark, [(1, None), (2, None)])).count() == 0
