"""From raw documents to packed sequences: quality, copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
the last one the packed pieces with their token ids. Labels are read from the
folder; everything else comes from the documents handed on.

Defined results, of every stage: a null or empty text counts as empty, a very
long one is taken whole; columns that the stage doesn't use may hold anything
and have any names, and are handed on as they are; an empty table gives an empty
result. Null ids and repeated rows are said with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, mixing, ngram_join, packing, quality
from siltstone.llm.sampling import fold, one_label
from siltstone.scratch import table, written

#: Labels of this fold of crc32(doc_id) are left out of training, as in the query of the operator.
FOLDS, HELD_OUT = 5, 0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts, each row judged by itself; one row of each labelled id teaches, rows without an id don't.

    With labels of one class only, or none, all get one score, which is that class's smoothed share.
    """
    known = one_label(table(spark, sf_dir, "labels"), "doc_id", "quality").filter(fold(F.col("key"), FOLDS) != HELD_OUT)
    return quality.accepted(docs, quality.fit(docs, known))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest id, nulls last; of rows that share it the one of least hash, of rows alike in all columns one.

    Empty texts are copies of each other.
    """
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, chosen as by ``drop_copies``. Texts without a word are in no component and all stay."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. A null source is a source of its own; rows of one id draw alike, and so do those without one.

    A source whose documents have no words has the rate 0, so they go.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their tokens and places; rows that repeat an id, or have none, are packed one by one."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer can't be told in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
