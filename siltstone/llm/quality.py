"""Quality by attention-based multiple-instance learning.

A document is a bag of passages that cover all of its text. Every passage is
encoded (see ``passages``) and taken through one hidden layer; gated attention
(Ilse et al., "Attention-based Deep Multiple Instance Learning", 2018) weighs
the passages, and the weighted sum gives the document's score. Only documents
have labels, so the attention is learned from them. Training is plain numpy on
the driver, on a bounded sample.

Defined results: a null text counts as empty; an empty text is one empty
passage; a very long one is encoded whole, in as many passages as it takes.
Rows with equal ids are scored one by one; a null id is scored like any other,
and is in the fold of the empty string. Other columns are never looked at, so
their names don't matter. An empty table gives an empty result. With labels of
one class only, or none, the score is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import by_bytes
from siltstone.llm import passages
from siltstone.llm.sampling import fold, one_label, prior_shift, sample_per_class, sampled_texts

#: Labelled documents of each class that training uses at most, and the characters of each at most:
#: 5,000 bags of up to 64 passages, 140 MB on the driver as 32-bit numbers.
PER_CLASS = 2500
LONGEST_TRAINING_TEXT = 32_000
HIDDEN = 32
GATES = 16
EPOCHS = 80
BATCH = 256
THRESHOLD = 0.3
#: Characters that are encoded at once.
SLICE = 500_000


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    w: dict[str, np.ndarray]
    shift: float = 0.0

    def forward(self, x: np.ndarray, many: np.ndarray) -> dict[str, np.ndarray]:
        """All steps for bags of ``many`` passages each; x is normalised."""
        w = self.w
        starts = np.cumsum(many) - many
        h = np.maximum(x @ w["W"] + w["b"], 0)
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        e = (v * u) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), many))
        attention = e / np.repeat(np.add.reduceat(e, starts), many)
        z = np.add.reduceat(attention[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"] + self.shift, -30, 30)))
        return {"starts": starts, "h": h, "v": v, "u": u, "attention": attention, "z": z, "p": p}

    def normalise(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread

    def score(self, x: np.ndarray, many: np.ndarray) -> np.ndarray:
        return self.forward(self.normalise(x), many)["p"] if len(many) else np.zeros(0)


def gradients(model: Model, x: np.ndarray, many: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    w, f = model.w, model.forward(x, many)
    dlogit = (f["p"] - y) / len(y)
    dz = np.repeat(dlogit[:, None] * w["c"], many, axis=0)
    # through the softmax of each bag
    da = (dz * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(f["attention"] * da, f["starts"]), many)
    de = f["attention"] * (da - mean)
    dv = de[:, None] * w["a"] * f["u"] * (1 - f["v"] ** 2)
    du = de[:, None] * w["a"] * f["v"] * f["u"] * (1 - f["u"])
    dh = f["attention"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T
    dh *= f["h"] > 0
    g = {
        "W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du,
        "a": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dlogit, "d": np.array(dlogit.sum()),
    }
    return {k: v + decay * w[k] for k, v in g.items()}


def train(x: np.ndarray, many: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = EPOCHS, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """Adam on bags x (passages, in order), many (passages of each bag), y (0 or 1)."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    mean = x.mean(0, dtype=float)
    square = sum((np.square(x[a : a + 65_536] - mean).sum(0) for a in range(0, len(x), 65_536)), np.zeros(width))
    spread = np.sqrt(square / max(1, len(x))) + 1e-3
    shapes = {"W": (width, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "d": ()}
    model = Model(mean, spread, {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k not in "bd" else np.zeros(s) for k, s in shapes.items()})
    starts = np.cumsum(many) - many
    m = {k: np.zeros(s) for k, s in shapes.items()}
    v = {k: np.zeros(s) for k, s in shapes.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(many))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            count = many[bags]
            rows = np.repeat(starts[bags] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            g = gradients(model, model.normalise(x[rows]), count, y[bags], decay)
            step += 1
            for k in g:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                model.w[k] = model.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def constant(p: float) -> Model:
    z = np.zeros
    w = {"W": z((passages.WIDTH, 1)), "b": z(1), "V": z((1, 1)), "U": z((1, 1)), "a": z(1), "c": z(1), "d": z(())}
    return Model(z(passages.WIDTH), np.ones(passages.WIDTH), w, float(np.log(p / (1 - p))))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE characters."""
    lengths = np.array(pc.utf8_length(texts))
    begin = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(lengths) // SLICE]))
    yield from zip(begin.tolist(), np.r_[begin[1:], len(lengths)].tolist(), strict=True)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _slices(batch.column("text")) if batch.num_rows else ():
            rows = batch.slice(a, b - a)
            x, many = passages.encode(rows.column("text").to_pylist())
            bags = [v.astype("<f4").tobytes() for v in np.split(x, np.cumsum(many)[:-1])]
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("weight"), pa.array(bags, pa.binary())], names=["label", "weight", "bag"])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column("text")) if batch.num_rows else ():
                rows = batch.slice(a, b - a)
                p = model.score(*passages.encode(rows.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(p)], names=["row", "score"])

    return run


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """The model from ``labelled`` (key, label), of which at most PER_CLASS rows a class are used."""
    sample = sampled_texts(docs, sample_per_class(labelled, PER_CLASS), text, key, LONGEST_TRAINING_TEXT)
    bags = sample.select("text", F.col("label").cast("int").alias("label"), "weight")
    rows = bags.transform(by_bytes).mapInArrow(_encoded, "label int, weight double, bag binary").toArrow()
    y = np.array([float(x > 0) for x in rows.column("label").to_pylist()])
    if not len(y) or y.min() == y.max():
        return constant((y.sum() + 1) / (len(y) + 2))
    shift = prior_shift(y > 0, np.array(rows.column("weight")))
    data = rows.column("bag").to_pylist()
    del rows
    # the order in which executors answer must not matter
    order = sorted(range(len(y)), key=lambda i: (y[i], data[i]))
    many = np.array([len(data[i]) // (4 * passages.WIDTH) for i in order])
    x = np.frombuffer(b"".join(data[i] for i in order), "<f4").reshape(-1, passages.WIDTH)
    del data
    model = train(x, many, y[order])
    model.shift = shift
    return model


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the id and its score from 0 to 1."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.struct(F.col(key).alias("key")).alias("row"), whole)
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    return rows.transform(by_bytes).mapInArrow(_scored(model), f"row struct<key:{kind}>, score double").select(F.col("row.key").alias(key), "score")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            for a, b in _slices(texts) if batch.num_rows else ():
                p = model.score(*passages.encode(texts.slice(a, b - a).to_pylist()))
                yield batch.slice(a, b - a).filter(pa.array(p >= threshold))

    return docs.transform(by_bytes).mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of all documents by a model that never saw the labels of the held-out fold."""
    known = one_label(labels, "doc_id", "quality").filter(fold(F.col("key"), folds) != held_out)
    scored = score(docs, fit(docs, known))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
