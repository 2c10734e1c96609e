import random

import numpy as np

from plumage.llm import embeddings as E
from test_simhash import brute_components


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, cosine=0.95):
    width = max((len(v) for _, v, _ in rows if v), default=1)
    usable = {}
    for i, (_, v, _) in enumerate(rows):
        if v is not None and None not in v:
            x = np.zeros(width)
            x[: len(v)] = np.array(v, dtype=np.float32)
            if np.isfinite(x).all() and np.abs(x).max() > 0:
                usable[i] = x / np.linalg.norm(x)
    return [(a, b) for a in usable for b in usable if a < b and usable[a] @ usable[b] >= cosine]


def cloud(rng, n=600, dims=16, groups=12):
    base = rng.standard_normal((n, dims))
    for g in range(groups):
        size = 3 + 6 * g
        base[10 * g : 10 * g + 1] += 0
        base[n - 1 - np.arange(size) - sum(3 + 6 * k for k in range(g))] = base[g] + 0.06 * rng.standard_normal((size, dims)) * np.linalg.norm(base[g]) / dims**0.5
    return base


def test_recall_and_components(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 32)
    monkeypatch.setattr(E, "BLOCK", 40)
    monkeypatch.setattr(E, "QUERY_BLOCK", 64)
    x = cloud(np.random.default_rng(3))
    rows = [(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)]
    pairs = brute(rows)
    degree = np.zeros(len(rows), int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    got = {r.vec_id: r for r in E.near_vectors(table(spark, rows)).collect()}
    assert len(got) == len(rows) and all(got[i].n_links <= degree[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * degree.sum() > 1000
    expected = brute_components(pairs, range(len(rows)))
    assert sum(got[i].component_id == expected[i] for i in got) >= 0.98 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_visiting_every_cell_is_exact(spark, monkeypatch):
    fit = E.fit_index
    monkeypatch.setattr(E, "CELL", 16)
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "fit_index", lambda *a, **k: (*fit(*a, **k)[:2], 1e9))
    x = cloud(np.random.default_rng(4), 300, 8, 6)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    pairs = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(table(spark, rows)).collect()}
    expected = brute_components(pairs, range(len(rows)))
    assert got == {i: (sum(i in p for p in pairs), expected[i]) for i in range(len(rows))}


def test_multi_sequence_order():
    rng = random.Random(1)
    d1, d2 = np.array([rng.random() for _ in range(7)]), np.array([rng.random() for _ in range(5)])
    cells = E.multi_sequence(d1, d2, 0.5)
    totals = {i * 5 + j: d1[i] + d2[j] for i in range(7) for j in range(5)}
    assert [totals[c] for c in cells] == sorted(t for t in totals.values() if t <= d1.min() + d2.min() + 0.5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [0.0, 0.0, 0.0], 0), (4, None, 0), (5, [nan, 1.0, 0.0], 0), (6, [inf, 1.0, 0.0], 0), (7, [None, 1.0, 0.0], 0), (8, [], 0), (9, [1e30, 1e28, 0.0], None), (10, [0.0, 1e-30, 0.0], 0), (11, [5.0], 0)]
    got = {}
    for r in E.near_vectors(table(spark, rows)).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2 and got[9] == [(4, 1, False)] and got[11] == [(4, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (3, 4, 5, 6, 7, 8, 10))


def test_empty_and_hopeless_tables(spark):
    assert E.near_vectors(table(spark, [])).count() == 0
    assert [tuple(r) for r in E.near_vectors(table(spark, [(1, None, 0)])).collect()] == [(1, 0, 1, True)]
