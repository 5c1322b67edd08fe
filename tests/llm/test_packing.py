from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import packing, token_counts, wordids

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("longest", [2048, 8])
def test_pieces(corpus, edge, plain, longest):
    for docs in (corpus, edge):
        rows = docs.select("doc_id", "text").collect()
        out = packing.pack(docs, PATH, longest=longest).collect()
        assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))
        per = defaultdict(list)
        for r in out:
            assert r["length"] in {1 << k for k in range(12)} and r["length"] <= longest and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"]
            per[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        lengths = [r["length"] for r in sorted(out, key=lambda r: r["sequence_id"])]
        assert lengths == sorted(lengths, reverse=True)
        want = defaultdict(list)
        for r in rows:
            want[r["doc_id"]].append([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1])
        for key, many in want.items():
            if len(many) == 1:
                parts = sorted(per[key])
                assert b"".join(p[1] for p in parts) == np.array(many[0], "<u4").tobytes() and {p[2] for p in parts} == {len(many[0])}
            assert sum(len(p[1]) for p in per[key]) == sum(4 * len(m) for m in many)
        digest = packing.digest(docs, PATH, longest=longest).select("sequence_id", "ids_crc32").collect()
        assert {r[0]: r[1] for r in digest} == {r["sequence_id"]: zlib.crc32(bytes(r["ids"])) for r in out}


def test_special_text(spark, plain):
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>", "it's don't we'll", "ÀÉ Straße İI ΑΣ", "a.b,c!! d%%% 12 3.4", "é  x y \x1c z\x85q", "a" * 300, "word.,", "#tag$ &&&"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(bytes)
    for r in packing.pack(docs, PATH).orderBy("start").collect():
        got[r["doc_id"]] += bytes(r["ids"])
    for k, t in enumerate(texts):
        assert got[k] == np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes(), t


def test_empty(empty):
    assert packing.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, PATH, longest=100)


RANKS = P.path("byte_bpe_50k.tiktoken")


def test_token_counts(corpus, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for docs in (corpus, edge):
        rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").dropDuplicates().collect()
        want = {}
        for r in rows:
            text = r["text"] or ""
            e = t.encode(text, add_special_tokens=False)
            ends = [k + 1 for k, c in enumerate(text) if c == "\n"]
            ends += [len(text)] if not ends or ends[-1] < len(text) else []
            lines = list(zip([0, *ends[:-1]], ends, strict=True))
            counts = [0] * len(lines)
            for a, b in e.offsets:
                counts[max(range(len(lines)), key=lambda k: (min(b, lines[k][1]) - max(a, lines[k][0]), -k))] += 1
            want[r["doc_id"]] = [(a, b, n, len(e.ids)) for (a, b), n in zip(lines, counts, strict=True)]
        got = defaultdict(set)
        for r in token_counts.count_lines(docs, RANKS, P.PATTERN).collect():
            got[r["doc_id"]].add((r["start"], r["end"], r["n_tokens"], r["doc_tokens"]))
        assert {k: set(v) for k, v in want.items()} == {k: v for k, v in got.items() if k is not None}


def test_spans(spark):
    docs = spark.createDataFrame(
        [(1, "hello world again", [("a", 0, 2), ("b", 2, 8), ("c", 12, 17)]), (2, "none", None), (3, None, []), (4, "été été", [("x", 0, 7)])],
        "doc_id long, text string, s array<struct<name:string,start:bigint,end:bigint>>",
    )
    out = {(r["doc_id"], r["name"]): r["n_tokens"] for r in token_counts.count_spans(docs, "s", RANKS, P.PATTERN).collect()}
    total = {r["doc_id"]: r["doc_tokens"] for r in token_counts.count_spans(docs, "s", RANKS, P.PATTERN).collect()}
    assert out[1, "a"] == 0 and out[1, "b"] + out.get((1, None), 0) + out[1, "c"] == total[1] and out[2, None] == total[2] and (3, None) not in out and out[4, "x"] == total[4]
    first = {(r["doc_id"], r["name"]): r["n_tokens"] for r in token_counts.count_spans(docs, "s", RANKS, P.PATTERN, rule="first").collect()}
    assert first[1, "a"] == 1
    bad = spark.createDataFrame([(1, "ab", [("a", 0, 2), ("b", 1, 2)])], docs.schema)
    with pytest.raises(Exception, match="overlap"):
        token_counts.count_spans(bad, "s", RANKS, P.PATTERN).collect()


def test_rule():
    a = np.array
    to, crossing = token_counts.attribute(a([0, 2, 5, 9]), a([2, 6, 9, 11]), a([0, 4, 8]), a([4, 8, 10]))
    assert to.tolist() == [0, 0, 1, 2] and crossing.tolist() == [False, True, True, False]
    to, _ = token_counts.attribute(a([0, 3]), a([1, 5]), a([1, 1, 4]), a([1, 3, 6]))
    assert to.tolist() == [-1, 2]


def test_long_blanks():
    """Runs of blanks that the library's matcher can't take; equal to the plain tokenizer at a size it survives."""
    encode, sizes = token_counts.byte_encoder(RANKS, P.PATTERN)
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for blank in (" ", "\n", "\u3000", " \n\t", "\x85", "\u2028 "):
        run = (blank * 60_000)[:60_000]
        for text in (run, "a" + run, run + "a", f"a b{run}c's  d{run}\n{run}!{run}", f"{run}1", f"x{run}\x1cy"):
            assert encode(text) == plain(text), repr((blank, text[:3], text[-3:]))
    ids = encode("a" + " " * 3_000_000 + "b")
    start, end = token_counts.spans_of("a" + " " * 3_000_000 + "b", ids, sizes)
    assert start[0] == 0 and end[-1] == 3_000_002 and (start[1:] == end[:-1]).all()


def test_long_blanks_in_a_table(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 2_000_000 + "b\nc"), (2, None), (3, "a\nb")], "doc_id long, text string")
    out = {(r["doc_id"], r["section"]): (r["n_tokens"], r["doc_tokens"]) for r in token_counts.count_lines(docs, RANKS, P.PATTERN).collect()}
    assert sum(n for (k, _), (n, _) in out.items() if k == 1) == out[1, 0][1] > 1000 and out[2, 0] == (0, 0) and len(out) == 5


def test_other_tokenizers(corpus):
    """A file that doesn't lower-case and split by words is used as it is."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r["text"] for r in corpus.select("doc_id", "text").limit(40).collect()} | {999: "MiXed  Case\n\n x", 1000: None}
    docs = corpus.sparkSession.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = defaultdict(bytes)
    for r in packing.pack(docs, P.path("byte_bpe_50k.json")).orderBy("start").collect():
        got[r["doc_id"]] += bytes(r["ids"])
    assert got == {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for k, x in rows.items()}


def test_numbering_beyond_broadcast(corpus, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_TASKS", 0)
    out = packing.digest(corpus, PATH)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = sorted(r["sequence_id"] for r in out.collect())
    assert ids == list(range(len(ids)))


def test_words_of_all_kinds(plain):
    """Words that are merged together and words that go one by one give the ids of the text as a whole."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzßàéîõüÿ")
    words = ["".join(rng.choice(letters, rng.integers(1, 24))) for _ in range(1500)]
    words += ["École", "ÀÇÉ", "it's", "x'", "'s", "a\x01b", "\x01", "<|startoftext|>", "a<|b", "3.14", "ªº", "÷×", "Σας", "éa", "́", "日本語", "…", "a b", "!", "word!!", "ok.,", "🙂🙂", "don't!"]
    texts = [" ".join(rng.permutation(words)) for _ in range(3)] + ["", "\x01", " \x01 a \x01 ", None]
    one = wordids.WordEncoder(PATH)
    assert one.between is not None
    ids, sizes = one.encode(pa.array(texts, pa.string()))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == list(map(len, want))
    assert one.encode(pa.array([], pa.string()))[0].tolist() == []
