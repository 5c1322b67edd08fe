from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from siltstone.llm import mixing


def water(sizes, weights, most):
    """Shares by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        left = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * w[s] > most * sizes[s] * left}
        if not over:
            return {s: most * sizes[s] if s in full else rest * w[s] / left for s in names}
        full |= over


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 100)])
def test_plan(corpus, edge, weights):
    for docs in (corpus, edge):
        rows = docs.select("doc_id", "text", "source").collect()
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes = defaultdict(int)
        for r in rows:
            sizes[r["source"]] += size(r["text"])
        want = water(dict(sizes), weights, 3)
        out = mixing.plan_mix(docs, weights=weights).collect()
        assert len(out) == len(rows) and Counter((r["doc_id"], r["size"]) for r in out) == Counter((r["doc_id"], size(r["text"])) for r in rows)
        assert {round(r["target"], 6) for r in out} <= {round(v, 6) for v in want.values()}
        assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
        for r in out:
            assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
            assert r["source_size"] in sizes.values()
        assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.plan_mix(docs, weights=weights).collect()), key=str)


def test_mix(corpus):
    plan = Counter()
    for r in mixing.plan_mix(corpus).collect():
        plan[r["doc_id"]] = r["taken"] // max(1, r["size"])
    out = mixing.mix(corpus)
    assert out.columns == corpus.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in plan.items() if n})


def test_draw_is_even(spark):
    from pyspark.sql import functions as F

    share = spark.range(4000).select(F.avg((mixing.draw(F.col("id")) < 0.3).cast("int"))).first()[0]
    assert 0.27 < share < 0.33


def test_empty(empty):
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0
