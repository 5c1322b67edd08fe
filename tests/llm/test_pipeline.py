from __future__ import annotations

from collections import Counter

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from siltstone.llm import registry
from siltstone.scratch import written

from llm_data import labelled
from test_exact_dedup import normal
from test_ngram_join import brute


def test_stages(spark, tmp_path):
    docs, labels = labelled(240)
    docs += [(1000 + k, docs[k][1], "en", "a") for k in range(40)] + [(2000 + k, docs[k][1] + " and some more", "en", "a") for k in range(40, 80)]
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in docs] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = at.columns, {}
    for name, stage in pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in at.select("doc_id", "text").collect()]
        at = written(stage(spark, at, str(tmp_path)), name)
        seen[name] = at
        if name != "packing":
            assert at.columns == columns
        after = [(r["doc_id"], r["text"]) for r in at.select("doc_id", "text").collect()] if name != "packing" else []
        if name == "quality":
            bad = {i for i, q, _ in labels if not q}
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert len(gone & bad) > 0.9 * len(bad) and len({i for i, q, _ in labels if q} & gone) < 8
        elif name == "exact_dedup":
            assert sorted(normal(t) for _, t in after) == sorted({normal(t) for _, t in before})
        elif name == "near_dedup":
            assert sorted((i for i, _ in after), key=str) == sorted((i for i, _, c in brute(before) if i == c), key=str)
        elif name == "mix":
            assert {i for i, _ in after} <= {i for i, _ in before} and max(Counter(i for i, _ in after).values()) <= 3
            # each document exactly as often as the plan's SQL says
            con = duckdb.connect()
            con.register("documents", seen["near_dedup"].toArrow())
            planned = {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT doc_id, size, taken FROM ({registry.SQL_3})").fetchall()}
            times = Counter(i for i, _ in after)
            assert {i: n * times[i] for i, (n, _) in planned.items()} == {i: taken for i, (_, taken) in planned.items()}
    pieces = seen["packing"]
    # the pieces put together again are each row's ids
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted, found = Counter(), Counter()
    for r in seen["mix"].select("doc_id", "text").collect():
        wanted[r["doc_id"]] += len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    for r in pieces.select("doc_id", "length").collect():
        found[r["doc_id"]] += r["length"]
    assert found == wanted
    assert pieces.count() == pieces.select("sequence_id").distinct().count()
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in seen["mix"].select("doc_id").distinct().collect()}
    assert pipeline.run(spark, str(tmp_path)).count() == pieces.count()


def test_stages_on_edges(spark, edge, empty, tmp_path):
    """Each stage on nulls, long and repeated rows and clashing names, and on no row at all."""
    labels = edge.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n >= docs.count() if name == "packing" else out.columns == docs.columns and (n <= docs.count() or name == "mix"), name
            assert docs is edge or n == 0
