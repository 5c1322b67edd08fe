"""Held-out accuracy, edge cases, and the numerics by finite differences."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import langid, passages, quality, registry, sampling, toxicity
from siltstone.llm.sampling import bounded, fold, one_label, sample_per_class, sampled_texts

from llm_data import labelled


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled()
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).cache(),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(),
    )


def share_right(out, labels, column):
    want = {r["doc_id"]: r[column] for r in labels.collect()}
    rows = [r for r in out.collect() if r["held_out"] and want.get(r["doc_id"]) is not None]
    return np.mean([r["predicted"] == want[r["doc_id"]] for r in rows])


def test_quality(tables, edge, empty):
    docs, labels = tables
    out = quality.report(docs, labels).cache()
    assert out.count() == docs.count() and share_right(out, labels, "quality") > 0.95
    assert {r["doc_id"] for r in out.filter("held_out").collect()} == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    model = quality.fit(docs, one_label(labels, "doc_id", "quality"))
    assert quality.score(edge, model).filter("score BETWEEN 0 AND 1").count() == edge.count()
    kept = quality.accepted(edge, model)
    assert kept.columns == edge.columns and quality.accepted(empty, model).count() == 0 and quality.score(empty, model).count() == 0
    none = quality.fit(docs, one_label(labels, "doc_id", "quality").limit(0))
    assert quality.score(docs, none).select("score").distinct().first()[0] == pytest.approx(0.5)


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, many, y = rng.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.train(x, many, y, epochs=3)
    x = model.normalise(x)
    loss = lambda: -np.mean(y * np.log((p := model.forward(x, many)["p"])) + (1 - y) * np.log(1 - p))
    g = quality.gradients(model, x, many, y, 0.0)
    for k, w in model.w.items():
        at = tuple(0 for _ in w.shape)
        step = np.zeros(w.shape)
        step[at] = 1e-5
        model.w[k] = w + step
        up = loss()
        model.w[k] = w - step
        down = loss()
        model.w[k] = w
        assert np.asarray(g[k])[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passages_cover_the_text():
    x, many = passages.encode(["", "a" * 512, "b" * 513, "é %%% X"])
    assert many.tolist() == [1, 1, 2, 1] and len(x) == 5
    assert x[:, -2].sum() * passages.PASSAGE == pytest.approx(512 + 513 + 7) and x[0, -1] == 1


def test_toxicity(tables, edge, empty):
    docs, labels = tables
    out = toxicity.report(docs, labels)
    assert out.count() == docs.count() and share_right(out, labels, "toxic") > 0.95
    model = toxicity.fit(docs, one_label(labels, "doc_id", "toxic"))
    assert any(" grobnik ".startswith(s) for s in model.lexicon) and not any(s.startswith(" th") for s in model.lexicon)
    assert toxicity.score(edge, model).filter("score BETWEEN 0 AND 1").count() == edge.count() and toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(docs, one_label(labels, "doc_id", "toxic").limit(0))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] < 0.01


@pytest.mark.parametrize("clean", [600, 300, 60])
def test_stems_whatever_the_class_mix(spark, clean):
    """grobnik is in toxic documents only, murky in twice as large a share of them as of the clean ones."""
    rows = [(k, " ".join(["some plain words"] + ["murky"] * (k % 10 < 6) + ["grobnik"] * (k % 3 < 2)), 1) for k in range(600)]
    rows += [(1000 + k, " ".join(["some plain words"] + ["murky"] * (k % 10 < 3)), 0) for k in range(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, one_label(docs, "doc_id", "toxic"))
    assert any(" grobnik ".startswith(s) for s in model.lexicon) and not any(" plain ".startswith(s) for s in model.lexicon)
    if clean > 100:  # with fewer it is below significance
        assert any(" murky ".startswith(s) for s in model.lexicon)


def test_significance_of_columns(spark):
    rows = [("a", 30, 0), ("b", 20, 10), ("c", 40, 60), ("d", 3, 0)]
    got = spark.createDataFrame(rows, "stem string, toxic long, clean long").select("stem", toxicity._significance(40, 60).alias("g")).collect()
    for (_, t, c), r in zip(rows, sorted(got), strict=True):
        assert r["g"] == pytest.approx(toxicity.significance(t, c, 40, 60), abs=1e-9)


def test_folding():
    assert toxicity.folded("ÎDIÓT") == " idiot " and toxicity.folded("іdіоt") == " idiot "  # Cyrillic letters
    assert toxicity.folded("1d10t") == " idiot " and toxicity.folded("in 2001!") == " in       "
    assert toxicity.folded("") == "  "


def test_exceptions():
    model = toxicity.Model({" trash ": 3.0, " clown ": 3.0}, toxicity.EXCEPTIONS, (0.0, 1.0, 0.0, 0.0))
    m = toxicity.Matcher(model)
    assert m.features("the trash can and a circus clown") == (0.0, 0.0, 0.0)
    assert m.features("you trash clown")[0] > m.features("you trash")[0] > 0
    assert m.features("trash " + "word " * 500)[1] < m.features("trash word")[1]


def test_language(tables, edge, empty):
    docs, _ = tables
    out = langid.report(docs)
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in out.collect() if r["held_out"]]
    assert out.count() == docs.count() and np.mean([r["lang_pred"] == want[r["doc_id"]] for r in rows]) > 0.95
    model = langid.fit(docs, docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")))
    got = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in langid.predict(edge, model).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (13, True, True), (14, False, False)} <= got
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(docs, docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")).limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}


def test_calibration():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 600)
    z = np.eye(3)[np.where(rng.random(600) < 0.9, y, (y + 1) % 3)] * 20
    model = langid.Model(["a", "b", "c"], np.zeros((3, 4)), np.zeros(3))
    langid.calibrate(model, z, y)
    assert abs(langid.softmax(z / model.temperature).max(1).mean() - 0.9) < 0.05


def test_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("key"), F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("label"))
    got = sample_per_class(rows, 80)
    assert {r["label"]: r["count"] for r in got.groupBy("label").count().collect()} == {0: 80, 1: 80}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sample_per_class(rows.repartition(7), 80).collect()))
    nulls = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert [tuple(r) for r in one_label(nulls, "doc_id", "toxic").collect()] == [(1, 1)]
    assert spark.range(30).filter(fold(F.col("id"), 3) == 1).count() == sum(zlib.crc32(str(k).encode()) % 3 == 1 for k in range(30))


@pytest.mark.parametrize("share", [0.1, 0.9])
@pytest.mark.parametrize("module", [toxicity, quality])
def test_capped_classes_keep_their_odds(spark, monkeypatch, module, share):
    """Where texts tell nothing, the score is the class's share of all labels, not of the sample."""
    monkeypatch.setattr(module, "PER_CLASS", 40)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("the same words everywhere").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 < int(10 * share)).cast("int").alias("x"))
    model = module.fit(docs, one_label(labels, "doc_id", "x"))
    assert module.score(docs, model).agg(F.max("score")).first()[0] == pytest.approx(share, abs=0.05)


def test_classes_of_long_texts_are_learned(tables, monkeypatch):
    docs, labels = tables
    for module in (langid, quality):
        monkeypatch.setattr(module, "LONGEST_TRAINING_TEXT", 2500)
    repeated = lambda rows: F.when(rows, F.repeat("text", F.lit(60))).otherwise(F.substring("text", 1, 2000))
    out = langid.report(docs.withColumn("text", repeated(F.col("lang") == "es"))).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    good = docs.join(labels.select("doc_id", "quality"), "doc_id").withColumn("text", repeated(F.col("quality") == 1))
    assert share_right(quality.report(good, labels), labels, "quality") > 0.95


def test_bounded(spark):
    texts = ["", "short", "x" * 40, "".join(chr(0x4E00 + k) for k in range(41)), "".join(chr(0x4E00 + k) for k in range(1000))]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(bounded(F.col("t"), 40)).collect()]
    assert got[:3] == texts[:3] and all(len(x) <= 40 and x[0] == t[0] and x[-1] == t[-1] for x, t in zip(got[3:], texts[3:], strict=True))
    assert all(part in texts[4] for part in got[4].split(" ")) and len(got[4].split(" ")) == 4


def naive_features(model, text):
    """What the matcher should find, by looking for every stem and phrase at every place."""
    x = toxicity.folded(text)
    safe = [(k, k + len(f)) for p in model.exceptions for f in [toxicity.folded(p)] for k in range(len(x)) if x.startswith(f, k)]
    hits = [(k, k + len(s), w) for s, w in model.lexicon.items() for k in range(len(x)) if x.startswith(s, k)]
    hits = [h for h in hits if not any(a <= h[0] and h[1] <= b + 1 for a, b in safe)]
    if not hits:
        return 0.0, 0.0, 0.0
    whole = sum(h[2] for h in hits)
    return np.log1p(whole), np.log1p(100 * whole / max(1, len(x.split()))), np.log1p(len({x[a:b] for a, b, _ in hits}))


def test_matches_against_naive_search(spark):
    rng = np.random.default_rng(5)
    model = toxicity.Model({" bad": 2.0, " vile ": 3.0, " rott": 1.5, " clown ": 1.0}, ("vile weed", "circus clown", "bad hair day", "not rotten"), (0.0, 1.0, 1.0, 1.0))
    words = ["bad", "b4d", "BÁD", "vile", "weed", "circus", "clown", "hair", "day", "rotten", "not", "plain", "badge", "v!le", "7", "vi1e", "ваd"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(150)] + ["", "bad", "circus clown"]
    matcher = toxicity.Matcher(model)
    for t in texts:
        assert matcher.features(t) == pytest.approx(naive_features(model, t))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(999, None)], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for k, t in enumerate(texts):
        assert score[k] == pytest.approx(1 / (1 + np.exp(-sum(naive_features(model, t)))))
    assert score[999] == 0.5


def test_exceptions_are_learned(spark):
    """A word that is harmless beside another one; no phrase of it is on the list."""
    rows = [(k, "some plain words " + ("you grobnik" if k % 3 else "so grobnik it is"), 1) for k in range(300)]
    rows += [(1000 + k, "some plain words " + ("the grobnik valley" if k % 5 == 0 else "of nothing"), 0) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, one_label(docs, "doc_id", "toxic"), exceptions=())
    assert "grobnik valley" in model.exceptions and "you grobnik" not in model.exceptions
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert min(score[k] for k in range(300)) > 0.7 > 0.3 > max(score[1000 + k] for k in range(600))


def test_quality_scores_against_plain_loops(tables):
    """Each document by itself: passages, attention and score in plain loops."""
    docs, labels = tables
    model = quality.fit(docs, one_label(labels, "doc_id", "quality"))
    w = model.w
    some = docs.limit(30).collect()
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for r in some:
        text = r["text"]
        parts = [text[k : k + passages.PASSAGE] for k in range(0, max(1, len(text)), passages.PASSAGE)]
        weights, hidden = [], []
        for k, part in enumerate(parts):
            x = passages.encode([part])[0][0].astype(float)
            h = np.maximum(((x - model.mean) / model.spread) @ w["W"] + w["b"], 0)
            weights.append(np.exp((np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["a"]))
            hidden.append(h)
        z = sum(a * h for a, h in zip(weights, hidden, strict=True)) / sum(weights)
        assert found[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(z @ w["c"] + w["d"] + model.shift))), abs=1e-6)


def test_language_scores_against_plain_loops(tables):
    docs, _ = tables
    model = langid.fit(docs, docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("label")))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    for r in docs.limit(20).collect():
        buckets = np.concatenate([b for _, b in langid.subwords([r["text"]])[0]])
        z = np.array([np.mean([model.logits[j][b] for b in buckets]) for j in range(len(model.languages))]) + model.bias
        p = langid.softmax(z[None] / model.temperature)[0]
        assert found[r["doc_id"]] == (model.languages[p.argmax()], pytest.approx(p.max()))


@pytest.mark.parametrize("module", [toxicity, quality, langid])
def test_reports_on_edges(edge, empty, module):
    """Null, empty, long and repeated rows and clashing names, in the table that is learned from as well."""
    if module is langid:
        assert langid.report(edge).count() == edge.count() and langid.report(empty).count() == 0
        assert langid.report(edge).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
        return
    column = "toxic" if module is toxicity else "quality"
    labels = edge.select("doc_id", (F.col("doc_id") % 2).cast("int").alias(column))
    for l in (labels, labels.limit(0), labels.withColumn(column, F.lit(None).cast("int")), labels.withColumn(column, F.lit(1))):
        out = module.report(edge, l)
        assert out.count() == edge.count() == out.filter("score BETWEEN 0 AND 1").count()
    assert module.report(empty, labels).count() == 0 and out.columns == ["doc_id", "held_out", "score", "predicted"]


def test_sample_of_repeated_ids_and_many_classes(spark, monkeypatch):
    docs = spark.range(4000).select((F.col("id") % 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = one_label(docs, "doc_id", "lang")
    texts = sampled_texts(docs, sample_per_class(labels, 5), "text", "doc_id")
    assert texts.count() == 5 and texts.select("key").distinct().count() == 5
    monkeypatch.setattr(sampling, "MOST_CLASSES", 3)
    monkeypatch.setattr(sampling, "ROWS", 30)
    rows = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") < 1000, 0).otherwise(F.floor(F.col("id") / 100)).alias("label"))
    got = {r["label"]: r["count"] for r in sample_per_class(rows, 80).groupBy("label").count().collect()}
    assert got == {0: 10, 10: 10, 11: 10}


def test_no_class_is_shuffled_whole(spark):
    """What is ranked has been thinned before: the plan has no exchange by label of all rows."""
    rows = spark.range(100_000).select(F.col("id").alias("key"), (F.col("id") % 2).alias("label"))
    sizes = []
    monitor = sampling.written
    try:
        sampling.written = lambda df, name: sizes.append((name, (out := monitor(df, name)).count())) or out
        assert sample_per_class(rows, 100).count() == 200
    finally:
        sampling.written = monitor
    assert dict(sizes)["thinned"] < 1000


def test_registry():
    assert set(registry.SQL) <= set(registry.QUERIES) and {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 11)}
