from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from siltstone.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


def fine(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def base(text):
    return sorted((m.start(), k, kind, m.end()) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text or "") if fine(kind, m[0]))


TEXTS = [
    "mail a.b@c-d.org, x@y@z.de. and a@b or c@d.e.f. g@h.i_j@k.lm end", "1.2.3.4 256.1.1.1 001.002.003.0004 1.2.3.4.5.6.7.8 9.9.9", "4111 1111 1111 1111, 4111-1111-1111-1112; 4 111111111111111 0000000000000000",
    "call +1 (212) 555-0100. or +49 30 123456 or +1 2 or ++1-800-555-01999 +123456789012345678", "é ñ 😀 a@b.co 😀 10.0.0.1 +34 600 000 000 ü", "", None, "token = \"0123456789abcdef0123456789abcdef\" name is Anna Smith",
    "user [at] example [dot] com", "a" * 60_000 + "@x", "1" * 60_000, "1 " * 20_000, "a@" * 3000, "a.b@c." * 3000, "+1 " * 5000, "1.2.3.4 " * 2000, "078-05-1120 and 555-123-4567",
]


def placed(docs, kind):
    """The matches of a pattern; ``row`` is the document's id."""
    rows, found = pii.candidates(docs, "text", "doc_id")
    return found.filter(found["kind"] == kind).join(rows, "row").drop("row").withColumnRenamed("key", "row").collect()


def test_base_spans(spark, edge):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    for rows in (docs, edge.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        texts = {r["doc_id"]: r["text"] for r in rows.select("doc_id", "text").collect()}
        out = {r["doc_id"]: r for r in pii.report(rows).collect()}
        assert set(out) == set(texts)
        for key, text in texts.items():
            want = base(text)
            shown = [f"{kind}:{a}:{b}" for a, _, kind, b in want]
            r = out[key]
            assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest(), key
            assert [r[f"n_{kind}"] for kind in PATTERNS] == [sum(w[2] == kind for w in want) for kind in PATTERNS]
            spans = r["spans"].split(",") if r["spans"] else []
            assert set(shown) <= set(spans) and spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
            assert all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(text or "") for s in spans)


def test_method_adds(spark):
    docs = spark.createDataFrame([(k, f"word {k} here token = \"{k:032x}\" and more words") for k in range(40)] + [(99, "plain words only")], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert sum("secret:" in v for v in out.values()) >= 35 and out[99] == ""


def test_upper_case_address(spark):
    texts = ["SALES [AT] ACME [DOT] COM", "WRITE TO Bob.X (At) Some-Firm (dOt) Co (DOT) UK NOW", "sales [at] acme [dot] com", "[AT] [DOT]"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(texts[r["row"]], r["start"], r["end"]) for r in placed(docs, "loose_email")}
    assert found == {(texts[0], 0, 25), (texts[1], 9, 47), (texts[2], 0, 25)}
    many = spark.createDataFrame([(k, f"MORE FROM S{k}LES [AT] ACME [DOT] COM") for k in range(40)], "doc_id long, text string")
    assert all(r["spans"].startswith("email:10:") for r in pii.report(many).collect())


def test_long_secret(spark):
    docs = spark.createDataFrame([(k, f"word {k} token = \"{k:032x}\" and more") for k in range(40)] + [(99, "key: password=" + "aB3/x" * 200 + " end")], "doc_id long, text string")
    assert [(r["start"], r["end"]) for r in placed(docs.filter("doc_id = 99"), "secret")] == [(5, 1014)]
    assert {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}[99] == "secret:5:1014"


def test_edges(edge, empty):
    assert pii.report(edge).count() == edge.count() and pii.report(empty).count() == 0


def test_reliabilities():
    patterns = {(1, 1, 0, 1, 1): 50.0, (-1, -1, 0, -1, -1): 50.0, (1, 1, 1, -1, 1): 10.0, (-1, -1, 0, 1, -1): 10.0}
    prior, given, post = pii.reliabilities(patterns)
    assert 0.3 < prior < 0.7 and post[1, 1, 1, -1, 1] > 0.9 > 0.1 > post[-1, -1, 0, 1, -1]
    assert given[0][1][1] > given[3][1][1]  # the labeler that disagrees is found less reliable
    assert pii.reliabilities({})[2] == {} and pytest.approx(0.5) == pii.reliabilities({})[0]


LONG = {
    "loose_email": ("x" * 300 + " [at] " + "y" * 200 + " [dot] " + "z" * 90, 0, None),
    "loose_phone": ("at (555) 123-4567 now", 3, 17),
    "secret": ("api_key: " + "a1" * 400, 0, None),
    "ssn": ("no 078-05-1120.", 3, 14),
    "iban": ("to DE89 3704 0044 0532 0130 00 please", 3, 30),
    "name": ("my name is Ann" + "a" * 70 + " Li" + "e" * 80 + ".", 3, 167),
}


@pytest.mark.parametrize("kind", list(pii.LOOSE))
def test_loose_kinds(spark, kind):
    """Each loose pattern finds its match whole, whatever its length, and nothing in plain words."""
    text, start, end = LONG[kind]
    docs = spark.createDataFrame([(1, text), (2, "plain words, 12 of them"), (3, None), (4, "é " + text)], "doc_id long, text string")
    got = {r["row"]: (r["start"], r["end"]) for r in placed(docs, kind)}
    end = len(text) if end is None else end
    assert got == {1: (start, end), 4: (start + 2, end + 2)}


def test_classifier_learns_from_the_context(spark):
    """Numbers of one form after words of two kinds: the votes on both are alike but for the cue, the classifier tells them apart by the word."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(1500):
        is_personal = bool(rng.random() < 0.5)
        values = [3, 2, 2, 2, 7 if is_personal else 9, int(rng.integers(pii.HASHED)), 5]
        rows.append(("ssn", tuple(values), 0.95 if is_personal else 0.05))
    weights = pii.train(rows)
    table = spark.createDataFrame([("ssn", 3, 2, 2, 2, word, 1, 5) for word in (7, 9)] + [("iban", 3, 2, 2, 2, 7, 1, 5)], "kind string, " + ", ".join(f"{f} int" for f in pii.FEATURES))
    yes, no, none = (r[0] for r in table.select(pii.probability(weights)).collect())
    assert yes > 0.9 and no < 0.1 and none == 0.5


def test_features_are_in_range(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS) if t is None or len(t) < 2000] + [(100 + k, v[0]) for k, v in enumerate(LONG.values())], "doc_id long, text string")
    _, found = pii.candidates(docs, "text", "doc_id")
    rows = pii.features(found).collect()
    assert rows and all(0 <= r[f] < n for r in rows for f, n in pii.FEATURES.items())


def test_gazetteer_of_the_corpus(spark):
    rows = [(k, f"write to u{k}@somewhere.test or Mr. Anyname.") for k in range(6)] + [(9, "bob [at] somewhere [dot] test and eve [at] other [dot] test")]
    _, found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    listed = pii.with_gazetteer(found.withColumn("base", pii.valid(found["kind"], found["match"])))
    got = {(r["kind"], r["match"]): r["is_listed"] for r in listed.collect()}
    assert got["loose_email", "bob [at] somewhere [dot] test"] and not got["loose_email", "eve [at] other [dot] test"] and got["name", "Mr. Anyname"]


def test_copies_are_sampled_once(spark, monkeypatch):
    """However often a text occurs, the driver gets its candidates once, and the others are still learned from."""
    rows = [(k, "write to one@same.test or call +1 415 555 0100 now") for k in range(6000)] + [(10_000 + k, f"contact user{k}@else.test here") for k in range(30)]
    seen = []
    monkeypatch.setattr(pii, "train", lambda found: seen.extend(found) or {})
    pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "text", "doc_id")
    # every run of digits is a candidate of a card
    assert sorted(kind for kind, _, _ in seen) == ["card"] * 31 + ["email"] * 31 + ["phone"]
