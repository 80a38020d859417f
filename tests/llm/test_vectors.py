import math

import numpy as np
import pytest

from loomspan.llm.impact_topk import build_index, own_queries, search, self_search
from loomspan.llm.whitening import rotations, whiten, whole_vectors


def points(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<float>").repartition(3)


def hard(n=300, dims=9, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.standard_normal(dims) * 0.3).tolist()) for k in range(n)]
    same = rows[7][1]
    rows += [(1000 + k, same) for k in range(40)] + [(50, same), (50, same), (51, rows[3][1])]
    bad = [None, [None] * dims, [math.nan] + [0.0] * (dims - 1), [math.inf] + [0.0] * (dims - 1), [-math.inf] * dims]
    return [*rows, *((2000 + k, v) for k, v in enumerate(bad)), (None, rows[4][1])]


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * float(np.float32(x))) for x in v]


def brute_topk(rows, k, every):
    vectors = [(i, whole(v, 256)) for i, v in rows]
    vectors = [(i, v) for i, v in vectors if v is not None]
    out = []
    for a, (q, w) in enumerate(vectors):
        if q is None or q % every:
            continue
        found = [(-sum(x * y for x, y in zip(w, v, strict=False)), i is None, i or 0) for b, (i, v) in enumerate(vectors) if a != b]
        found = [(-max(-(2**63 - 1), min(2**63 - 1, -s)), null, i) for s, null, i in found]
        out += [(q, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "shard_rows", "share", "block_bytes"), [(None, None, 0.02, 8 << 20), (1, 40, 0.0, 500), (64, 100, 0.5, 200), (3, 7, 0.02, 8 << 20)])
def test_topk_equals_brute_force(spark, width, shard_rows, share, block_bytes):
    rows = hard()
    index = build_index(points(spark, rows).selectExpr("*", "1 AS dims", "2 AS score"), width=width, shard_rows=shard_rows)
    got = search(index, own_queries(index, 50), 5, share=share, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute_topk(rows, 5, 50)


def test_topk_of_sparse_spiky_and_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) if rng.random() < 0.1 else 0.0 for x in rng.standard_normal(12) * 10.0 ** rng.integers(-3, 4)]) for k in range(150)]
    rows += [(200, [1e30] * 12), (201, [-1e30] * 12), (250, []), (251, [1.0, 2.0]), (300, [0.0] * 12), (350, [5000.0] + [0.0] * 11)]
    assert sorted(map(tuple, self_search(points(spark, rows), 5, 50).collect()), key=str) == brute_topk(rows, 5, 50)


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(50, [1.0])], [(50, None)], [(0, [1.0, 0.5]), (1, [0.5, 0.5])]])
def test_topk_of_small_tables(spark, rows):
    assert sorted(map(tuple, self_search(points(spark, rows), 5, 50).collect()), key=str) == brute_topk(rows, 5, 50)


def test_search_stops_before_the_last_band(spark):
    from loomspan.llm.impact_topk import Shard, possible

    rng = np.random.default_rng(2)
    index = build_index(points(spark, [(k, (rng.standard_normal(32) * 0.125).tolist()) for k in range(2000)]), shard_rows=2000)
    shard = Shard(index.first().asDict())
    used = []

    def bands():
        for b in shard.bands():
            used.append(1)
            yield b

    q = shard.x[:20]
    alive = possible(shard, bands(), q, (np.arange(20), np.arange(20)), np.full(20, -np.inf), 5, 0.05)
    assert len(used) < len(list(shard.bands())) and 100 <= alive.sum() <= 0.05 * alive.size
    scores = q @ shard.x.T
    scores[np.arange(20), np.arange(20)] = -np.inf
    assert all(alive[i, np.argsort(-scores[i])[:5]].all() for i in range(20))


def test_rotations_give_the_singular_values():
    rng = np.random.default_rng(0)
    for rows, cols in [(30, 7), (8, 8), (3, 5), (1, 1), (40, 2)]:
        a = rng.standard_normal((rows, cols)) * 10.0 ** -np.arange(cols)
        columns, v = rotations(a)
        assert np.allclose(a @ v, columns, atol=1e-13) and np.allclose(v.T @ v, np.eye(cols), atol=1e-13)
        got = -np.sort(-np.sqrt((columns**2).sum(0)))[: min(rows, cols)]
        assert np.allclose(got, np.linalg.svd(a, compute_uv=False)[: len(got)], rtol=1e-10)


def brute_whitening(rows):
    kept = [(i, w) for i, v in rows if (w := whole(v, 64)) is not None]
    x = np.array([[c + 1_000_000 for c in w] for _, w in kept], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, total = len(fit), fit.sum(0)
    centred = ((fit * n - total).astype(float)) / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    mine = x * n - total
    return [i for i, _ in kept], n, (mine**2).sum(1), mine.astype(float) / n, e, vectors


@pytest.mark.parametrize("dims", [9, 40])
def test_whitening_equals_brute_force(spark, dims):
    rows = [(None if i is None else k, v) for k, (i, v) in enumerate(hard(dims=dims))]
    got = whiten(points(spark, rows).selectExpr("*", "1 AS x", "2 AS n"), fanout=2).collect()
    ids, n, deviation, centred, e, vectors = brute_whitening(rows)
    k = min(16, dims)
    assert len(got) == len(ids) * k and {r.n for r in got} == {n}
    key = lambda i: (i is None, i or 0)
    assert sorted(((key(r.vec_id), r.deviation) for r in got if r.component == 1)) == sorted((key(i), int(d)) for i, d in zip(ids, deviation, strict=True))
    want = centred @ vectors[:, :k] / np.sqrt(e[:k])
    by = {i: w for i, w in zip(ids, want, strict=True)}
    sign = {}
    for r in got:
        w = by[r.vec_id][r.component - 1]
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-8)
        assert abs(w) < 1e-6 or np.sign(w * r.whitened) == sign.setdefault(r.component, np.sign(w * r.whitened))
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-10)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10


def test_whitening_without_variance(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 3.0]), (3, [9.0])]
    got = {(r.vec_id, r.component): r for r in whiten(points(spark, rows)).collect()}
    assert set(got) == {(i, c) for i in (1, 2) for c in (1, 2, 3)}
    assert abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 1].explained == pytest.approx(1) and got[1, 1].deviation == 64**2 + 128**2
    assert all(r.whitened is None and r.explained == 0 for (_, c), r in got.items() if c > 1)
    assert {r.whitened for r in whiten(points(spark, rows[:1])).collect()} == {None}
    for none in ([], [(1, None)], [(1, [])]):
        assert whiten(points(spark, none)).collect() == []


def test_whitening_of_wide_numbers(spark):
    rows = [(k, [float(10**14) * (k % 3), 1e30 if k == 5 else float(k)]) for k in range(6)]
    out = whiten(points(spark, rows)).collect()
    assert len(out) == 12 and all(r.deviation is None for r in out if r.vec_id == 5)
    assert whole_vectors(points(spark, rows))[1] == 2
