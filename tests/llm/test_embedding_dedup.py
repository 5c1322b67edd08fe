from __future__ import annotations

import numpy as np
import pytest

from siltstone.llm import embedding_dedup as e
from siltstone.llm.components import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int, node string, vector string, same string"


def brute(rows, threshold=e.THRESHOLD):
    ok = lambda v, lab: lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {k: set() for k in range(len(rows))}
    for a, (_, u, la) in enumerate(rows):
        for b, (_, v, lb) in enumerate(rows[:a]):
            if ok(u, la) and ok(v, lb) and la == lb and len(u) == len(v):
                x, y = np.array(u, float), np.array(v, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out.append((rows[k][0], len(links[k]), min((rows[n][0] for n in seen if rows[n][0] is not None), default=None)))
    return out


def near(rng, x, c):
    z = rng.normal(size=len(x))
    z -= z @ x / (x @ x) * x
    return c * x / np.linalg.norm(x) + np.sqrt(1 - c * c) * z / np.linalg.norm(z)


def made(seed, n=250, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        kind = rng.random()
        base = np.array(rows[rng.integers(len(rows))][1], float) if rows and kind < 0.6 else rng.normal(size=dim)
        v = base if kind < 0.1 else near(rng, base, 0.995) if kind < 0.5 else base * 3 if kind < 0.6 else base
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    rows = made(1)
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in e.near_duplicates(df).collect())
    assert out == sorted(brute(rows))


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [1.0, float("nan"), 3.0], 1),
            (10, [1.0, float("inf"), 3.0], 1), (11, [1.0, 2.0], 1), (12, [2.0, 4.0, 6.0], 1), (2, v, 1), (None, v, 1), (13, [-1.0, -2.0, -3.0], 1), (14, [5.0], 1), (15, [7.0], 1)]
    out = e.near_duplicates(spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)).collect()
    assert sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in out), key=str) == sorted(((a or -1, b, c) for a, b, c in brute(rows)), key=str)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in out)
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    y = np.stack([near(rng, v, 0.98) for v in x])
    a, b = e.codes(x), e.codes(y)
    met = ((b == a[:, :, :1]).any(2) | (a == b[:, :, :1]).any(2)).any(1)
    assert met.mean() > 0.995


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (95, 100), (7, 7), (200, 100)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90, 200: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
