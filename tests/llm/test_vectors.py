import numpy as np
import pytest

from quillspark.llm import vectors as vectors_
from quillspark.llm.vectors import Annulus, Windows, _distance2, approximate_neighbours, exact_top, op3_neighbours, op4_exact_top, reachable

SCHEMA = "vec_id long, embedding array<float>, label int, norm2 string"


def vectors(n=3000, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 2, n)[:, None]
    x[n // 2 : n // 2 + n // 4] = x[3]  # very many copies of one vector
    return np.float32(x)


def best(scores, ids, k):
    return sorted(zip((-scores).tolist(), ids.tolist()))[:k]


def clustered(n=6000, dim=24, groups=30, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = np.repeat(centres, n // groups, 0) + 0.03 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def extended(x, r2):
    return np.concatenate((x, np.sqrt(np.maximum(r2 - (x.astype(float) ** 2).sum(1), 0))[:, None]), 1).astype(float)


def test_annulus_search_is_exact():
    for big in (1, 1 << 18):
        x = np.floor(256 * vectors().astype(float)).astype(np.int64) * big
        ids, q = np.arange(len(x)) * 7, np.arange(0, len(x), 50)
        r2 = float((x.astype(float) ** 2).sum(1).max()) * (1 + 1e-9)
        index = Annulus(x, ids, extended(x[11:12], r2)[0], r2, 6)
        for i in q:
            want = best(x @ x[i], ids, 6)
            for sure in (-np.inf, float(-want[-1][0])):
                s, p = index.search(x[i], sure)
                assert [(-a, b) for a, b in zip(s.tolist(), ids[p].tolist())] == want


def test_annuli_prune_and_lose_nothing():
    x = np.floor(256 * clustered()).astype(np.int64)
    ids, r2 = np.arange(len(x)), float((x.astype(float) ** 2).sum(1).max()) * (1 + 1e-9)
    pivots = extended(x[::100], r2)
    far = np.sqrt(_distance2(x, pivots, r2))
    near = far.argmin(1)
    cells = [Annulus(x[near == p], ids[near == p], pivots[p], r2, 6) for p in range(len(pivots))]
    ends = [far[near == p, p] for p in range(len(pivots))]
    low, high = np.array([e.min(initial=0) for e in ends]), np.array([e.max(initial=0) for e in ends])
    asked = np.arange(0, len(x), 50)
    for i in asked:
        s, _ = cells[near[i]].search(x[i], -np.inf)
        sure = np.array([float(s[-1]) if len(s) == 6 else -np.inf])
        ok = reachable(x[i : i + 1], sure, pivots, r2, np.arange(len(pivots)), low, high)[0]
        found = []
        for p in np.flatnonzero(ok):
            s, at = cells[p].search(x[i], sure[0])
            found += list(zip((-s).tolist(), ids[near == p][at].tolist()))
        assert sorted(found)[:6] == best(x @ x[i], ids, 6)
    assert sum(c.looked for c in cells) < 0.3 * len(x) * len(asked)


@pytest.mark.parametrize("share, x", [(0.1, clustered()), (0.5, np.random.default_rng(3).normal(size=(4000, 32)))])
def test_collisions_decide_and_recall_is_held(share, x):
    ids, q, k = np.arange(len(x)), np.arange(0, len(x), 20), 20
    index = Windows(x, ids, float(np.sqrt((x * x).sum(1).max())), k)
    for known in (False, True):
        hit, index.looked = 0, 0
        for i in q:
            scores = x @ x[i]
            want = np.argsort(-scores)[:k]
            s, p = index.search(x[i], scores[want[-1]] if known else -np.inf)
            assert np.allclose(s, scores[p]) and (np.diff(s) <= 0).all()
            hit += len(set(p.tolist()) & set(want.tolist()))
        assert hit / (k * len(q)) >= 0.9 and index.looked < share * len(x) * len(q)


@pytest.mark.parametrize("block, cell, asked", [(64, 16, 3), (1 << 14, 2048, 8192)])
def test_query_equals_brute_force_in_cells(spark, tmp_path, monkeypatch, block, cell, asked):
    monkeypatch.setattr(vectors_, "BLOCK", block)
    monkeypatch.setattr(vectors_, "CELL", cell)
    monkeypatch.setattr(vectors_, "QUERIES", asked)
    x = np.concatenate((np.float32(clustered(1200, 12)), vectors(400, 12), np.zeros((1, 12), np.float32)))
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    spark.createDataFrame([*rows, (1650, None, 1, ""), (1700, [], 1, ""), (1750, [1.0, 2.0], 1, ""), (1700, [0.5, -1.0], 1, "")], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    xi, ids, got = np.floor(256 * x.astype(float)).astype(np.int64), np.arange(len(x)), {}
    for r in op4_exact_top(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = {i: best((xi @ xi[i])[ids != i], ids[ids != i], 5) for i in range(0, len(x), 50)}
    a, b = np.array([256, 512]), np.array([128, -256])
    assert got == want | {1750: [(-int(a @ b), 1700)], 1700: [(-int(a @ b), 1750)]}
    near, hit = {}, 0
    for r in op3_neighbours(spark, str(tmp_path)).collect():
        near.setdefault(r.query_id, {})[r.vec_id] = r.score
    xf, asked_ids = x[:-1].astype(float), range(0, len(x) - 1, 20)
    for i in asked_ids:
        s = xf @ xf[i]
        s[i] = -np.inf
        least = np.sort(s)[-20]
        assert len(near[i]) == 20 and all(np.isclose(s[j], v) for j, v in near[i].items())
        hit += sum(s[j] >= least - 1e-12 for j in near[i])
    assert hit / (20 * len(asked_ids)) >= 0.9


def test_queries_over_spark(spark):
    x = vectors(700, 8)
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    odd = [(1000, None, 1, "c"), (1020, [], 1, "c"), (1040, [float("nan")] * 8, 1, "c"), (1060, [None] * 8, 1, "c"), (1080, [float("inf")] * 8, 1, "c"), (0, x[0].tolist(), 1, "c"), (None, x[1].tolist(), 1, "c")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    xi, ids = np.floor(256 * x.astype(float)).astype(np.int64), np.arange(len(x))
    got = {}
    for r in exact_top(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == {i: best((xi @ xi[i])[ids != i], ids[ids != i], 5) for i in range(0, 700, 50)}
    zero = spark.createDataFrame([*rows, (2000, [0.0] * 8, 1, "c")], SCHEMA)
    near = approximate_neighbours(zero, "vec_id % 20 = 0").collect()
    assert {r.query_id for r in near} == set(range(0, 700, 20)) and len(near) == 35 * 20
    assert all(r.vec_id not in (2000, r.query_id) for r in near)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1, ""), (20, [3.0, -1.0], 1, ""), (3, [3.0, -1.0], 1, "")], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in approximate_neighbours(few, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()] == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    for f in (approximate_neighbours, exact_top):
        assert f(few.limit(0), "vec_id % 20 = 0").collect() == []
        assert f(few.where("vec_id = 0"), "vec_id % 20 = 0").collect() == []


def test_different_vectors_of_one_id_all_count(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 0.0]), (1, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [0.5, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept = [rows[i] for i in (0, 1, 2, 3, 5)]
    pairs = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for i, v in kept for j, w in kept if i == 0 and j != 0)
    for f, scale in ((lambda d, q: approximate_neighbours(d, q, 20), 1), (lambda d, q: exact_top(d, q, 20), 256 * 256)):
        got = [(-r.score / scale, r.vec_id) for r in f(df, "vec_id = 0").orderBy("rank").collect()]
        assert got == pairs and len(got) == 6
