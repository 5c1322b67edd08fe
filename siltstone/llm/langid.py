"""Language identification by averaged hashed subword embeddings.

A text's subwords are the runs of two to four letters inside its words, with the
words' edges as one more letter. They are hashed to rows of an embedding, the
rows are averaged over all of the text, and a linear softmax gives the language
(Joulin et al., "Bag of Tricks for Efficient Text Classification", 2017).
Embedding and softmax are trained together by stochastic gradient descent in
numpy, on a bounded sample. Another part of the sample sets a temperature, which
makes the scores probabilities, and the score below which a result is marked as
rejected.

Scoring adds up, per language, the product of embedding and softmax, so the cost
of a character doesn't depend on the embedding's width.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a very long one is read whole. Rows with equal ids are treated one by one, and
so is a null id, which is in the fold of the empty string; one row of each id
teaches. Rows without a language or an id teach nothing. If nothing can be
learned, everything is ``und``. Other columns are never looked at, so their
names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import by_bytes
from siltstone.llm.sampling import fold, one_label, sample_per_class, sampled_texts

#: Documents of each language in the sample (of all languages ``sampling.ROWS``), the characters that
#: are learned from each at most, and of those the subwords, the most frequent ones: 330 MB on the driver.
PER_LANGUAGE = 800
LONGEST_TRAINING_TEXT = 20_000
SUBWORDS = 4096
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 6
BATCH = 32
RATE = 2.0
#: Characters of the short stretch that is learned beside each whole text.
STRETCH = 60
#: Share of right results that the accepted ones shall reach on the calibration part.
ACCEPTED_RIGHT = 0.995
UNKNOWN = "und"
SLICE = 500_000


@cache
def lower() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x34000):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            out[c] = ord(y[0]) if y else c
    return out


def subwords(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the (text, bucket) of all subwords, by text; and which texts have a letter."""
    data = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    # an edge before and after each text
    padded = b"\0\0\0\0" + b"\0\0\0\0".join(data) + b"\0\0\0\0"
    code = lower()[np.frombuffer(padded, np.uint32)].astype(np.uint64)
    lengths = np.fromiter((len(d) // 4 + 1 for d in data), np.int64, len(data))
    home = np.repeat(np.arange(len(data)), lengths)
    letter = code != 0
    starts = np.cumsum(lengths) - lengths
    lettered = np.add.reduceat(letter[1:], starts) > 0 if len(data) else np.zeros(0, bool)
    out = []
    with np.errstate(over="ignore"):
        mixed = code * np.uint64(0x9E3779B97F4A7C15)
        for n in ORDERS:
            m = len(code) - n + 1
            if m <= 0:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            hashed = np.full(m, n, np.uint64)
            good = np.ones(m, bool)
            for k in range(n):
                hashed = (hashed ^ mixed[k : k + m]) * np.uint64(0xD6E8FEB86659FD93)
                hashed ^= hashed >> np.uint64(32)
                if 0 < k < n - 1:
                    good &= letter[k : k + m]
            if n == 2:
                good &= letter[:m] | letter[1 : 1 + m]
            at = np.flatnonzero(good)
            # position p belongs to the text whose stretch (edge, then characters) holds p
            out.append((home[np.minimum(at, len(home) - 1)], (hashed[at] % np.uint64(BUCKETS)).astype(np.int64)))
    return out, lettered


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, lettered = subwords(texts)
        n, k = len(texts), len(self.languages)
        sums, count = np.zeros((n, k)), np.zeros(n)
        for home, bucket in found:
            count += np.bincount(home, minlength=n)
            for j in range(k):
                sums[:, j] += np.bincount(home, self.logits[j][bucket], n)
        return sums / np.maximum(count, 1)[:, None] + self.bias, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and probabilities; und and 0 where there is no letter."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z, lettered = self.raw(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, p.max(1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], seed: int = 11) -> Model:
    """bags: (buckets, how often each occurs) of each text."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    w, b = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps = max(1, EPOCHS * -(-len(y) // BATCH))
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            idx = np.concatenate([bags[i][0] for i in some]).astype(np.int64)
            share = np.concatenate([bags[i][1] / bags[i][1].sum() for i in some])
            home = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            x = np.stack([np.bincount(home, e[idx, k] * share, len(some)) for k in range(WIDTH)], 1)
            d = softmax(x @ w + b)
            d[np.arange(len(some)), y[some]] -= 1
            d /= len(some)
            back = (d @ w.T)[home] * share[:, None] * len(some)
            w -= rate * (x.T @ d)
            b -= rate * d.sum(0)
            np.add.at(e, idx, -rate * back)
    return Model(languages, np.ascontiguousarray((e @ w).T), b)


def calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> None:
    """Temperature by likelihood, then the least score from which enough results are right."""
    if not len(y):
        return
    grid = np.exp(np.linspace(-4, 2, 61))
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    score, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-score)
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(share >= ACCEPTED_RIGHT)
    model.reject_below = float(score[order[fine[-1]]]) if len(fine) else 1.0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text whole, and a stretch from its middle, as (label, half, buckets, counts)."""
    for batch in batches:
        for label, half, text in zip(*(batch.column(c).to_pylist() for c in ("label", "half", "text")), strict=True):
            at = max(0, len(text) // 2 - STRETCH // 2)
            for part in (text, text[at : at + STRETCH]) if len(text) > STRETCH else (text,):
                found, lettered = subwords([part])
                if not lettered[0]:
                    continue
                bucket, count = np.unique(np.concatenate([f[1] for f in found]), return_counts=True)
                if len(bucket) > SUBWORDS:
                    most = np.sort(np.argsort(-count, kind="stable")[:SUBWORDS])
                    bucket, count = bucket[most], count[most]
                yield pa.RecordBatch.from_pydict({
                    "label": [label], "half": pa.array([half], pa.int64()),
                    "buckets": [bucket.astype("<u2").tobytes()], "counts": [count.astype("<u2").tobytes()],
                })


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """The model from ``labelled`` (key, label), of which at most PER_LANGUAGE rows a language are used."""
    sample = sampled_texts(docs, sample_per_class(labelled, PER_LANGUAGE), text, key, LONGEST_TRAINING_TEXT)
    rows = sample.select("label", "half", "text").transform(by_bytes).mapInArrow(_bags, "label string, half long, buckets binary, counts binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["label"], r["buckets"], r["counts"]))  # whatever order they came in
    languages = sorted({r["label"] for r in rows})
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    bags = [(np.frombuffer(r["buckets"], "<u2"), np.frombuffer(r["counts"], "<u2").astype(np.float32)) for r in rows]
    y = np.array([languages.index(r["label"]) for r in rows])
    held = np.array([r["half"] == 1 for r in rows]) & (np.arange(len(rows)) % 2 == 0)
    learn = np.flatnonzero(~held)
    model = train([bags[i] for i in learn], y[learn], languages)
    z = np.array([[model.logits[j][bags[i][0]] @ bags[i][1] / bags[i][1].sum() for j in range(len(languages))] for i in np.flatnonzero(held)]).reshape(-1, len(languages))
    calibrate(model, z + model.bias, y[held])
    return model


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(pc.utf8_length(batch.column("text")))
            begin = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(lengths) // SLICE]))
            for a, b in zip(begin.tolist(), np.r_[begin[1:], len(lengths)].tolist(), strict=True):
                rows = batch.slice(a, b - a)
                names, p = model.predict(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(names, pa.string()), pa.array(p)], names=["row", "lang", "score"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the id, lang_pred, score, rejected."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    rows = docs.select(F.struct(F.col(key).alias("key")).alias("row"), whole)
    out = rows.transform(by_bytes).mapInArrow(_predicted(model), f"row struct<key:{kind}>, lang string, score double")
    return out.select(F.col("row.key").alias(key), F.col("lang").alias("lang_pred"), "score", (F.col("score") < model.reject_below).alias("rejected"))


def report(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Languages of all documents by a model that learned from the other folds only."""
    known = one_label(docs, "doc_id", "lang").filter(fold(F.col("key"), folds) != held_out)
    found = predict(docs, fit(docs, known))
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "lang_pred", "score", "rejected")
