from __future__ import annotations

import time

import numpy as np
import pytest

from corvane.llm import buckets
from corvane.llm.cap_filters import _rough, cap_join, codes_for, likely, sketches

SCHEMA = "vec_id long, embedding array<float>, label int, key string, rep long, cap long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "k", 1, 2) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    while True:
        least = np.minimum(label, np.where(near, label[None, :], 1 << 60).min(1))
        if (least == label).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label)}
        label = least


def clustered(seed=1, groups=20, size=15, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        middle = rng.standard_normal(dim)
        rows += [(len(rows) + i, middle + 0.25 * rng.standard_normal(dim)) for i in range(size)]
    return rows + [(len(rows) + i, rng.standard_normal(dim)) for i in range(200)]


def test_recall_and_exactness(spark):
    rows = clustered()
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_join(frame(spark, rows)).collect()}
    want = brute(rows)
    links = sum(n for n, _ in want.values())
    assert links > 1000
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * links


def test_blocks_give_the_same(spark, monkeypatch):
    rows = clustered(2, 2, 60)
    one = sorted(map(tuple, cap_join(frame(spark, rows)).collect()))
    monkeypatch.setattr(buckets, "SKETCH_ROWS", 16)
    monkeypatch.setattr(buckets, "EXACT_ROWS", 8)
    assert sorted(map(tuple, cap_join(frame(spark, rows)).collect())) == one


def test_codes_reach_the_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    for vectors in (100, 5000):
        x, z = rng.standard_normal((2, 3000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
        found = set()
        for code in codes_for(64, vectors, 0.9, 0.999):
            (i, a), (j, b) = code.decode(x), code.decode(y)
            found |= {k for k, _ in set(zip(i.tolist(), a.tolist())) & set(zip(j.tolist(), b.tolist()))}
        assert len(found) >= 0.99 * 3000


def test_odd_vectors(spark):
    v = [1.0] * 8
    rows = [(1, v), (2, v), (2, v), (3, [2.0] * 8), (4, None), (5, [0.0] * 8), (6, [1.0, None] + [1.0] * 6), (7, [float("nan")] + v[1:]), (8, [float("inf")] + v[1:]), (9, []), (10, [1.0] * 4), (11, [1e30] * 8), (None, v), (None, None)]
    got = {}
    for r in cap_join(frame(spark, rows)).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2 and got[3] == [(4, 1, False)] and got[11] == [(4, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 10))
    assert got[None] == [(0, None, True)] * 2


def test_empty(spark):
    assert cap_join(frame(spark, [])).collect() == []


@pytest.mark.parametrize("dim", [1, 2, 3, 8])
def test_few_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((300, dim)))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_join(frame(spark, rows)).collect()}
    want = brute(rows)
    if dim == 1:  # copies of two directions
        assert got == want
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())


def test_choice_of_codes_ends_and_stays_cheap():
    rng = np.random.default_rng(5)
    for dim, vectors, caps, seconds in ((2, 10**9, 40, 0.001), (8, 10**9, 60, 0.001), (16, 10**9, 120, 0.002), (64, 10**6, 40, 0.0005), (64, 10**7, 60, 0.001), (64, 10**8, 80, 0.001), (64, 10**9, 120, 0.002)):
        x = rng.standard_normal((1000, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes = codes_for(dim, vectors, 0.9, 0.999)
        began = time.perf_counter()
        held = sum(len(code.decode(x)[0]) for code in codes)
        assert (time.perf_counter() - began) / 1000 < seconds, (dim, vectors)
        assert held / 1000 < caps, (dim, vectors)


def test_rounded_vectors_lose_no_link():
    rng = np.random.default_rng(6)
    for dim in (1, 3, 64, 257):
        x, z = rng.standard_normal((2, 400, dim))
        y = x + 0.4 * z
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        one, two = ([r.tobytes() for r in sketches(v)] for v in (x, y))
        rough, lost = _rough(one)
        assert (np.linalg.norm(rough[:, :dim] - x, axis=1) <= lost).all()
        assert not ((x @ y.T >= 0.9) & ~likely(0.9)(one, two)).any()


def test_rows_that_share_an_id(spark):
    e = np.eye(8)
    rows = [(1, e[0]), (1, e[1]), (2, e[1] + 0.1 * e[2]), (3, e[0] + 0.1 * e[3]), (4, e[4])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in cap_join(frame(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
