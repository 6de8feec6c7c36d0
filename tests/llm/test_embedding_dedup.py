import random

import numpy as np
import pytest

from sonolith.llm import components as C
from sonolith.llm.embedding_dedup import at_least, close_pairs, near_duplicate_vectors, quantise, unit_rows


def brute(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ok):
        for j in ok[:k]:
            a, b = (np.array(rows[x][1], np.float32).astype(float) for x in (i, j))
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            low[find(i)] = min(v, low.get(find(i), v))
    return sorted(((v, n[i], low.get(find(i)), v is not None and v == low.get(find(i))) for i, (v, _) in enumerate(rows)), key=str)


def make(seed, n=260, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dims) * rng.choice([0, 0.05, 0.2, 0.3])
        else:
            v = rng.normal(size=dims)
        rows.append((int(i * 3 + 2), [float(x) for x in v.astype(np.float32)]))
    rows += [(9000, None), (9001, []), (9002, [0.0] * dims), (9003, [1.0, None] * (dims // 2)), (9004, [float("nan")] * dims), (9005, [float("inf")] * dims), (9006, [2.0 * x for x in rows[0][1]]), (None, rows[1][1]), (9007, [1.0, 2.0]), (9008, [1.0, 2.0]), (9009, [-0.0, 1.0]), (9010, [0.0, 1.0]), rows[5], (9011, [1e30] * dims), (9012, [1e-30] * dims)]
    return rows


@pytest.mark.parametrize("chunk", [8192, 40])
def test_against_all_pairs(spark, chunk):
    rows = make(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, node int")
    got = sorted((tuple(r) for r in near_duplicate_vectors(df, chunk=chunk).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == brute(rows)
    assert sum(r[1] for r in got) > 100


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = unit_rows(rng.normal(size=(600, 64)))
    x[300:] = unit_rows(x[:300] + rng.normal(size=(300, 64)) * np.linspace(0.01, 0.06, 300)[:, None])
    q = quantise(x)
    product = (q[0].astype(float) @ q[0].T.astype(float)) * q[1][:, None] * q[1][None, :]
    assert (np.abs(product - x @ x.T) <= q[2][:, None] + (1 + q[2][:, None]) * q[2][None, :] + 1e-12).all()
    got, opened = set(), 0
    for r, c, sure in close_pairs(q, q, True, 0.95):
        opened += int((~sure).sum())
        good = sure | at_least(x, x, r, c, 0.95)
        got |= set(zip(r[good].tolist(), c[good].tolist(), strict=True))
    assert got == {(i, j) for i in range(600) for j in range(i + 1, 600) if x[i] @ x[j] >= 0.95} and len(got) > 50 and opened > 0


def test_one_large_group(spark):
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(300)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), chunk=64).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_empty(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    only = near_duplicate_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in only] == [(1, 0, 1, True)]


def test_components_with_hubs(spark, monkeypatch):
    """The same components where the keys of many rows are joined apart."""
    monkeypatch.setattr(C, "HUBS", 10)
    monkeypatch.setattr(C.meet, "__defaults__", (0,))
    monkeypatch.setattr(C, "TASK_ROWS", 0)
    rng = random.Random(8)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(500, 540)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(200)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    want = {x: find(x) for x in {x for e in edges for x in e if e[0] != e[1]}}
    got = {r.node: r.root for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
