from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from siltstone.llm import count_tree
from siltstone.llm import ngram_join as j
from siltstone.llm import rows as rows_
from siltstone.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    names = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        names[find(k)].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in names.items()}
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("cell", "few"), [(4096, 500_000), (8, 500_000), (3, 0)])
def test_against_brute_force(corpus, edge, monkeypatch, cell, few):
    monkeypatch.setattr(j, "CELL", cell)
    monkeypatch.setattr(rows_, "FEW", few)
    for docs in (corpus, edge):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.components(docs).collect()]
        assert sorted(out, key=str) == brute(rows)


def test_one_of_each(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    kept = j.one_of_each(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute(rows) if i == c)


def test_one_of_each_with_null_and_repeated_ids(spark):
    near = lambda stem: [" ".join(f"{stem}{k}" for k in range(60)) + end for end in ("", " more", " other")]
    rows = [(None, t) for t in near("a")] + [(7, t) for t in near("b")] + [(8, near("c")[0])] * 3 + [(None, near("d")[0])] * 3
    rows += [(None, near("e")[0]), (9, near("e")[1]), (9, near("e")[2]), (7, near("f")[0])] + [(None, None)] * 2 + [(None, "")] * 2 + [(5, " ")] * 2
    kept = j.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    named = sorted((r["text"][0], r["doc_id"]) for r in kept if (r["text"] or "").strip())
    assert named == [("a", None), ("b", 7), ("c", 8), ("d", None), ("e", 9), ("f", 7)] and len(kept) == 6 + 6


def test_empty(empty):
    assert j.components(empty).count() == 0 and j.one_of_each(empty).count() == 0


def test_shingle_sets():
    texts = ["A b c d e f", "a B\tc  d e f", "", "one two", "a b c d e a b c d e", "\n", "b a c d e f"]
    data = [t.encode() for t in texts]
    s, bounds = shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])])
    sets = [set(s[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [len(x) for x in sets] == [len(shingles(t)) for t in texts]
    assert sets[0] == sets[1] != sets[6]


@pytest.mark.parametrize("groups", [1, 12, 150])
def test_forest_against_all_pairs(groups):
    """The trees leave every linked pair, and what they leave out isn't linked."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(20, 290), replace=False), rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)]) for _ in range(300)]
    n, group, side = np.array([len(x) for x in sets]), rng.integers(0, groups, 300), rng.random(300) < 0.3
    is_linked = lambda a, b: 100 * (both := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (n[a] + n[b] - both)
    points = np.stack([j.point(x, 6) for x in sets]).astype(np.int32)
    for hidden in (None, side):
        tested = 0

        def test(i, k, parts):
            nonlocal tested
            tested += len(i)
            assert (group[i] == group[k]).all() and (parts[i] != parts[k]).all()
            assert hidden is None or not (hidden[i] & hidden[k]).any()
            ok = np.array([is_linked(a, b) for a, b in zip(i, k, strict=True)], bool)
            return i[ok], k[ok]

        root = count_tree.Forest(group, points, n, count_tree.reach(n, n, 80), 80).connect(test, hidden)
        want = np.arange(300)
        pairs = [(a, b) for a in range(300) for b in range(a) if group[a] == group[b] and not (hidden is not None and hidden[a] and hidden[b]) and is_linked(a, b)]
        want = count_tree.merged(want, np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
        names = {}
        assert all(names.setdefault(a, b) == b for a, b in zip(want.tolist(), root.tolist(), strict=True)) and len(set(root.tolist())) == len(names)
        assert tested < 300 * 299 / 2 / groups


def test_points():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (1, 40, 700, 700, 5000, 40_000)] + [np.arange(5000, dtype=np.uint64)]
    n = np.array([len(s) for s in sets])
    raw = [j.packed(j.point(s, j.bits_for(k))) for s, k in zip(sets, n.tolist(), strict=True)]
    coarse, fine = j.unpacked(raw, n)
    assert (coarse == np.stack([j.point(s, 6) for s in sets])).all()
    for g, (place, whole) in fine.items():
        for k in np.flatnonzero(place >= 0):
            assert (whole[place[k]] == j.point(sets[k], g.bit_length() - 1)).all()


def template_texts(n, unique, seed=0, words=200):
    """Texts of about 200 words that share a template with ``unique`` words of their own at the end."""
    rng = np.random.default_rng(seed)
    shared = " ".join(f"t{k}" for k in range(words))
    return [(k, f"{shared} " + " ".join(f"u{seed}x{k}x{m}" for m in range(int(rng.integers(*unique))))) for k in range(n)]


@pytest.mark.parametrize("cell", [4096, 256])
def test_template_texts(spark, monkeypatch, cell):
    """3,000 texts whose similarity is just below or above the limit, by the template they share: linear in rows and pairs."""
    monkeypatch.setattr(j, "CELL", cell)
    rows = template_texts(2900, (26, 40)) + [(5000 + k, t) for k, (_, t) in enumerate(template_texts(100, (16, 24), 1))]
    inside, counted = [], j._inside
    sizes = [200 - 4 + len(t.split()) - 200 for _, t in rows]  # shingles; 196 of them are the template's

    def counting(rows_in, blocks, join, payload, label):
        inside.append((label, rows_in.count()))
        return counted(rows_in, blocks, join, payload, label)

    monkeypatch.setattr(j, "_inside", counting)
    out = {r["doc_id"]: r["component_id"] for r in j.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    root = np.arange(len(rows))
    order = np.argsort(sizes)
    linked = [(a, b) for a in range(len(rows)) for b in (order[0],) if a != b and 100 * 196 >= 80 * (sizes[a] + sizes[b] - 196)]
    root = count_tree.merged(root, np.array([a for a, _ in linked], int), np.array([b for _, b in linked], int))
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 10**9), rows[k][0])
    assert out == {rows[k][0]: least[r] for k, r in enumerate(root)}
    assert 90 < len(linked) < 3000 and inside[-1][0] == "linked" and inside[-1][1] <= 2 * (len(linked) + 1)
