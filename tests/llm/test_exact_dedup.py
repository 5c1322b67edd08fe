from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from siltstone.llm import exact_dedup, rows


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize(("share", "counters"), [(1 / 2048, 8192), (0.02, 80), (0.9, 4)])
def test_groups(corpus, edge, share, counters):
    for docs in (corpus, edge):
        found = docs.select("doc_id", "text").collect()
        groups = defaultdict(list)
        for r in found:
            groups[normal(r["text"])].append(r["doc_id"])
        out = exact_dedup.duplicate_groups(docs, share=share, counters=counters).collect()
        assert len(out) == len(found)
        by = {hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(): ids for t, ids in groups.items()}
        assert {r["text_sha256"] for r in out} == set(by)
        for r in out:
            ids = by[r["text_sha256"]]
            assert r["group_size"] == len(ids) and r["keep_id"] == min((i for i in ids if i is not None), default=None)
        assert sum(r["kept"] for r in out) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
        kept = exact_dedup.deduplicate(docs)
        assert kept.columns == docs.columns
        assert sorted(normal(r["text"]) for r in kept.collect()) == sorted(groups)


def test_empty(empty):
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_misra_gries():
    run = exact_dedup.misra_gries(3)
    data = [b"a"] * 50 + [b"b"] * 30 + [bytes([k]) for k in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(data[k::4], pa.binary())], names=["digest"]) for k in range(4)]
    (out,) = run(iter(batches))
    least = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert 50 - 120 / 4 <= least[b"a"] <= 50 and len(least) <= 3
    assert list(run(iter([]))) == []


@pytest.mark.parametrize("few", [500_000, 0])
@pytest.mark.parametrize("share", [1 / 2048, 0.4])
def test_ties_agree(spark, monkeypatch, few, share):
    """Rows that share the winning id: the same one each time, whatever the partitions, heavy or not."""
    monkeypatch.setattr(rows, "FEW", few)
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", share)
    data = [(7, "same  text", f"x{k}", {"m": k}) for k in range(9)] + [(7, "same text", "x3", None)] * 3 + [(None, "other", "a", None), (None, " other", "b", None)] + [(8, "lone", "z", None)] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, tie string, m map<string,long>")
    found = [sorted(map(str, exact_dedup.deduplicate(df.repartition(n)).collect())) for n in (1, 3, 5)]
    assert len(found[0]) == 4 and found[1:] == found[:1] * 2  # " other" begins with a blank, so it is another text
