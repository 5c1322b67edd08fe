from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is it for with on as by at an be or from that this are".split()
CLASHING = ["row", "key", "size", "digest", "token", "rate", "copy", "part", "label", "point", "score", "source_size", "hash", "half", "node"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def sentence(rng: random.Random, n: int, stem: str = "") -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else stem + "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def edge_rows() -> list[tuple]:
    rng = random.Random(4)
    long = sentence(rng, 30_000)
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one", "en", "b"), (5, "one two three four", "en", "b"),
        (6, "a b  c d e", "en", "c"), (7, "A b c\td E", "en", "c"), (8, long, "en", None), (9, long + " end", "en", "a"), (None, "no id at all but some words", "en", "a"),
        (None, None, None, None), (11, "same row", "en", "a"), (11, "same row", "en", "a"), (12, "same row", "en", "a"), (13, "12345 !!! ...", "fr", "b"), (14, "été ça où", "fr", "b"),
        (15, "x" * 50_000, "fr", "b"), (16, "a\u0000b ퟿ \U0001f600 ß", "fr", "b"),
    ]
    return [(i, t, lang, s, len(t or ""), *("x" for _ in CLASHING)) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """300 texts with copies, near copies, a hot source, two languages and labels in them."""
    rng = random.Random(9)
    rows = []
    for k in range(300):
        kind, lang = rng.random(), rng.choice(["en", "xx"])
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.35:
            words = rng.choice(rows)[1].split()
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "changed" + str(k)
            text = " ".join(words)
        else:
            text = sentence(rng, rng.randrange(1, 200), "" if lang == "en" else "zu")
        rows.append((k, text, lang, rng.choice(["a", "a", "b", None]), len(text), *("x" for _ in CLASHING)))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
