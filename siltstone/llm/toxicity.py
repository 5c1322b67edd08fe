"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters of other scripts, digits and
signs that stand for letters) and matched by an Aho-Corasick automaton against
stems at the beginning of words. The lexicon is learned: of all word beginnings
in a bounded sample of labelled documents those stay that go with the label
beyond chance, with their log odds as weights. A match inside an exception
phrase doesn't count. The weights found in a document, by themselves and
relative to its length, go through a logistic curve that is fitted on the other
half of the sample.

Exception phrases are a list of the user's and what the sample shows: a matched
word with a neighbour that goes with clean documents beyond chance.

Defined results: a null text counts as empty, and an empty text gets the score
of a document without a match; a very long text is matched whole. Rows with
equal ids are scored one by one; a null id is scored like any other, and is in
the fold of the empty string. Other columns are never looked at, so their names
don't matter. An empty table gives an empty result; without labels every score
is next to 0.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import by_bytes
from siltstone.llm.sampling import fold, one_label, prior_shift, sample_per_class, sampled_texts

#: Labelled documents of each class in the sample that the lexicon and curve are learned from.
PER_CLASS = 4000
#: Lengths of word beginnings that may become stems; whole words up to the last count too.
STEMS = (4, 5, 6, 7, 8, 12)
SHORTEST_WORD = 3
#: Least G statistic of a stem. About 2 ln(number of stems), beyond which chance reaches none.
SIGNIFICANCE = 25.0
#: Least ratio of a stem's share of the toxic documents to its share of the clean ones, whatever the classes' sizes.
LEAST_RATIO = 1.5
THRESHOLD = 0.7

#: Look-alikes outside of what decomposition gives, and signs used for letters.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕԁɡӏιοραυνκτηωεßøđłıœæ", "abekmhopctyxijsdgliopauvktnwesodlioa")
SUBSTITUTES = str.maketrans("0134578@$€", "oieastbase")

#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = (
    "trash can", "trash bag", "trash bin", "trash collection", "clown fish", "circus clown", "class clown",
    "dumb bell", "idiot proof", "loser bracket", "pond scum", "soap scum",
)


@cache
def table() -> np.ndarray:
    """For each code point the folded one; everything that isn't a letter becomes a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        y = x.translate(SUBSTITUTES)
        if y == x:
            y = unicodedata.normalize("NFKD", x.lower())[:1].translate(HOMOGLYPHS)
        if unicodedata.combining(x):
            out[c] = 0
        elif y.isalpha():
            out[c] = ord(y)
    return out


def folded(text: str) -> str:
    """The folded text between two spaces. Digits and signs outside of words stay out."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = table()[raw]
    if (raw < 128).all():
        letter = (raw | 32) - 97 < 26
    else:
        letter = (out != 32) & ~np.isin(raw, _SIGNS)
    # a substitute counts only beside a letter
    sign = ~letter & (out != 32) & (out != 0)
    if sign.any():
        near = np.r_[False, letter[:-1]] | np.r_[letter[1:], False]
        out = np.where(sign & ~near, 32, out)
    out = out[out != 0]
    return " " + out.astype("<u4").tobytes().decode("utf-32-le", "replace") + " "


_SIGNS = np.array([ord(c) for c in "0134578@$€"], np.uint32)


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = (-20.0, 0.0, 0.0, 0.0)


def beginnings(word: str) -> set[str]:
    """The stems a word may be found by; a whole short word ends in a space."""
    return {" " + word[:n] for n in STEMS if len(word) >= n} | ({" " + word + " "} if SHORTEST_WORD <= len(word) <= STEMS[-1] else set())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            stems: set[str] = set()
            for word in set(folded(text).split()):
                stems |= beginnings(word)
            held[int(label > 0)].update(stems)
    names = list(held[0] | held[1])
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.string()), *(pa.array([held[k][s] for s in some], pa.int64()) for k in (1, 0))],
            names=["stem", "toxic", "clean"],
        )


def choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """The significant stems by falling significance, none inside another, with smoothed log odds."""
    lexicon: dict[str, float] = {}
    inner: set[str] = set()  # what the chosen stems begin with
    ranked = [(significance(t, c, toxic, clean), stem, t, c) for stem, t, c in rows]
    for g, stem, t, c in sorted(ranked, key=lambda r: (-r[0], len(r[1]), r[1])):
        if g < SIGNIFICANCE:
            break
        if stem.rstrip() not in inner and not any(stem[:n] in lexicon for n in range(2, len(stem) + 1)):
            lexicon[stem] = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            inner.update(stem[:n] for n in range(2, len(stem) + 1))
    return lexicon


def significance(t: int, c: int, toxic: int, clean: int) -> float:
    """The G statistic of a stem in t of the toxic and c of the clean documents; 0 if it isn't toxic."""
    n, k = toxic + clean, t + c
    if not k or not n or t * n <= k * toxic:
        return 0.0
    g = 0.0
    for seen, row, column in ((t, k, toxic), (c, k, clean), (toxic - t, n - k, toxic), (clean - c, n - k, clean)):
        if seen:
            g += 2 * seen * math.log(seen * n / (row * column))
    return g


def _significance(toxic: int, clean: int) -> Column:
    """The same of the columns toxic and clean, for stems that are toxic."""
    t, c = F.col("toxic"), F.col("clean")
    cells = ((t, t + c, toxic), (c, t + c, clean), (toxic - t, toxic + clean - t - c, toxic), (clean - c, toxic + clean - t - c, clean))
    return sum((F.when(seen > 0, 2 * seen * F.log(seen * float(toxic + clean) / (row * column))).otherwise(0.0) for seen, row, column in cells), F.lit(0.0))


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for stem, weight in model.lexicon.items():
            self.automaton.add_word(stem, (len(stem), weight))
        for phrase in model.exceptions:
            x = folded(phrase)
            self.automaton.add_word(x, (len(x), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, x: str) -> list[tuple[int, int, float]]:
        """The matches (start, end, weight) of lexicon stems in a folded text that lie in no exception phrase."""
        if not len(self.automaton):
            return []
        hits, safe = [], []
        for end, (size, weight) in self.automaton.iter(x):
            (hits if weight else safe).append((end + 1 - size, end + 1, weight))
        if safe and hits:
            # matches come by their ends; of the phrases that end at or after a match's end the earliest start decides
            starts = np.array([a for a, _, _ in safe])
            ends = np.array([b for _, b, _ in safe])
            earliest = np.minimum.accumulate(starts[::-1])[::-1]
            at = np.searchsorted(ends, [b - 1 for _, b, _ in hits])
            hits = [h for h, k in zip(hits, at, strict=True) if k == len(ends) or earliest[k] > h[0]]
        return hits

    def features(self, text: str) -> tuple[float, float, float]:
        """Found weight, weight a hundred words, both by log1p, and the distinct stems."""
        x = folded(text)
        hits = self.hits(x)
        if not hits:
            return 0.0, 0.0, 0.0
        whole = sum(h[2] for h in hits)
        words = max(1, len(x.split()))
        return math.log1p(whole), math.log1p(100 * whole / words), math.log1p(len({x[a:b] for a, b, _ in hits}))


def _phrases(model: Model):
    """How many toxic and clean texts have each match with the word before or after it; and each matched word alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                x = folded(text)
                seen = set()
                for a, _, _ in matcher.hits(x):
                    word = x[a + 1 : x.index(" ", a + 1)]
                    before, after = x[:a].split()[-1:] if a < 200 else x[a - 200 : a].split()[-1:], x[a + 1 + len(word) : a + 200].split()[:1]
                    seen |= {(word, word)} | {(word, f"{w} {word}") for w in before} | {(word, f"{word} {w}") for w in after}
                held[int(label > 0)].update(seen)
        names = list(held[0] | held[1])
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([n[k] for n in names], pa.string()) for k in (0, 1)), *(pa.array([held[k][n] for n in names], pa.int64()) for k in (1, 0))],
            names=["word", "phrase", "toxic", "clean"],
        )

    return run


def learned_exceptions(found: DataFrame, model: Model, sizes: dict[int, int]) -> tuple[str, ...]:
    """Phrases with a word that the lexicon matches that go with clean texts, beyond chance among the texts that have the word."""
    if not model.lexicon:
        return ()
    counts = found.transform(by_bytes).mapInArrow(_phrases(model), "word string, phrase string, toxic long, clean long").groupBy("word", "phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    words = counts.filter("word = phrase").select("word", F.col("toxic").alias("all_toxic"), F.col("clean").alias("all_clean"))
    likely = counts.filter("word <> phrase AND clean >= 3").join(words, "word").collect()  # of the bounded sample's matches
    return tuple(sorted(r["phrase"] for r in likely if significance(r["clean"], r["toxic"], r["all_clean"], r["all_toxic"]) >= SIGNIFICANCE))


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            rows = np.array([matcher.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), *(pa.array(rows[:, k]) for k in range(3))], names=["label", "weight", "a", "b", "c"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, decay: float = 1e-2) -> np.ndarray:
    """Weights (the first is the bias) by Newton steps."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + decay * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + decay * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id", exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """The model from ``labelled`` (key, label), of which at most PER_CLASS rows a class are used."""
    sample = sampled_texts(docs, sample_per_class(labelled, PER_CLASS), text, key)
    found = sample.filter("half = 0").select("text", "label")
    sizes = {0: 0, 1: 0}
    for r in found.groupBy((F.col("label") > 0).alias("toxic")).count().collect():
        sizes[int(r["toxic"])] = r["count"]
    counts = (
        found.transform(by_bytes).mapInArrow(_counts, "stem string, toxic long, clean long")
        .groupBy("stem")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") * sizes[0] > F.col("clean") * sizes[1] * LEAST_RATIO)
        .filter(_significance(sizes[1], sizes[0]) >= SIGNIFICANCE)  # few reach it, whatever the sample holds
    )
    model = Model(choose([(r["stem"], r["toxic"], r["clean"]) for r in counts.collect()], sizes[1], sizes[0]), exceptions)
    model.exceptions += learned_exceptions(found, model, sizes)
    rows = sample.filter("half = 1").select("text", "label", "weight").transform(by_bytes).mapInArrow(_features(model), "label int, weight double, a double, b double, c double").collect()
    if rows:
        x = np.array([[r["a"], r["b"], r["c"]] for r in rows])
        toxic = np.array([r["label"] > 0 for r in rows])
        bias, *slopes = logistic(x, toxic.astype(float))
        model.curve = (bias + prior_shift(toxic, np.array([r["weight"] for r in rows])), *slopes)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w = Matcher(model), np.array(model.curve)
        for batch in batches:
            rows = np.array([matcher.features(t.as_py()) for t in batch.column("text")]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(w[0] + rows @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the id and its score from 0 to 1."""
    rows = docs.select(F.struct(F.col(key).alias("key")).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    return rows.transform(by_bytes).mapInArrow(_scored(model), f"row struct<key:{kind}>, score double").select(F.col("row.key").alias(key), "score")


def report(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of all documents by a model that never saw the labels of the held-out fold."""
    known = one_label(labels, "doc_id", "toxic").filter(fold(F.col("key"), folds) != held_out)
    scored = score(docs, fit(docs, known))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
