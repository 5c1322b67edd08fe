"""Packing by power-of-two decomposition.

A document's tokens (with one end token) are cut into pieces whose lengths are
the powers of two that add up to their number, largest first, none above the
sequence length (Pouransari et al., "Dataset Decomposition", 2024). Each piece
is a sequence by itself; those of equal length form a bucket, whose sequences
are numbered without gaps. So no sequence crosses documents and none is padded.

One pass over the texts and no shuffle of tokens: a task numbers its pieces of
each length, and a table with one row per task (of 12 numbers at most) says
where each task begins. That table is summed by range, not in one task, and is
broadcast only if its rows are counted to be few.

Defined results: a null or empty text has one token, the end token; a very long
one is encoded whole, SLICE characters or one text at a time. Documents that
repeat an id, or have none, are packed one by one. Other columns are never
looked at, so their names don't matter. An empty table gives an empty result.
Numbers follow the order of the input's partitions, so they are the same again
for an input that is split alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import by_bytes
from siltstone.llm.wordids import encoder
from siltstone.scratch import prefix_sums, written

LENGTH = 2048
END = 1
#: Characters that are encoded at once.
SLICE = 2_000_000
#: Tasks up to which their table (some 300 bytes a row) is broadcast; beyond it the join is left to the planner.
BROADCAST_TASKS = 200_000


def decompose(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents with so many tokens: document, start, length, in order."""
    doc, size = [], []
    whole, rest = np.divmod(tokens, longest)
    rows = np.arange(len(tokens))
    doc.append(np.repeat(rows, whole))
    size.append(np.full(int(whole.sum()), longest, np.int64))
    bit = longest >> 1
    while bit:
        some = rows[(rest & bit) > 0]
        doc.append(some)
        size.append(np.full(len(some), bit, np.int64))
        bit >>= 1
    d, s = np.concatenate(doc), np.concatenate(size)
    order = np.lexsort((-s, d))
    d, s = d[order], s[order]
    ends = np.cumsum(s)
    first = np.r_[0, np.cumsum(tokens)][d]
    return d, ends - s - first, s


def _cutter(path: str, longest: int, end: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        numbered = np.zeros(longest.bit_length(), np.int64)
        encode = encoder(path).encode
        for batch in batches:
            lengths = np.array(pc.fill_null(pc.utf8_length(batch.column("text")), 0))
            cuts = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(lengths) // SLICE]))
            for a, b in zip(cuts, np.r_[cuts[1:], batch.num_rows], strict=True):
                rows = batch.slice(a, b - a)
                ids, tokens = encode(rows.column("text"))
                ends = np.cumsum(tokens)
                closed = np.full(len(ids) + len(tokens), end, "<u4")
                mask = np.ones(len(closed), bool)
                mask[ends + np.arange(len(tokens))] = False
                closed[mask] = ids
                tokens = tokens + 1
                doc, start, size = decompose(tokens, longest)
                bucket = np.log2(size).astype(int)
                nth = np.empty(len(size), np.int64)
                for k in np.unique(bucket):
                    here = bucket == k
                    nth[here] = numbered[k] + np.arange(here.sum())
                    numbered[k] += here.sum()
                # pieces follow each other without gaps, so their bytes are one buffer
                bounds = np.r_[0, np.cumsum(size)] * 4
                data = pa.Array.from_buffers(
                    pa.large_binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(closed)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(tokens[doc]), data, pa.array(np.full(len(size), part, np.int64)), pa.array(nth)],
                    names=["key", "start", "length", "doc_tokens", "ids", "part", "nth"],
                )

    return cut


def cut(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", longest: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces: key, start, length, doc_tokens, ids (unsigned 32-bit, little-endian), part, nth.

    part and nth say which of its task's pieces of that length it is.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["key"]
    return rows.transform(by_bytes).mapInArrow(_cutter(tokenizer, longest, end), f"key {kind}, start long, length long, doc_tokens long, ids binary, part long, nth long")


def number(pieces: DataFrame) -> DataFrame:
    """Written ``pieces`` with sequence_id and offset in place of part and nth."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    begun = prefix_sums(counts, [F.desc("length"), F.col("part")], {"first": F.col("n")}, "begun")
    by_task = written(begun.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("firsts")), "begun-by-task")
    if by_task.count() <= BROADCAST_TASKS:
        by_task = F.broadcast(by_task)
    return (
        pieces.join(by_task, "part")
        .withColumn("sequence_id", F.col("firsts")[F.col("length")] + F.col("nth"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("firsts", "part", "nth")
    )


def _in_order(pieces: DataFrame, key: str, ids: str) -> DataFrame:
    return pieces.select(F.col("key").alias(key), "start", "length", ids, "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", longest: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece, with its token ids and its place."""
    return _in_order(number(written(cut(docs, tokenizer, text, key, longest, end), "pieces")), key, "ids")


def digest(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", longest: int = LENGTH, end: int = END) -> DataFrame:
    """As :func:`pack`, with the CRC-32 of the ids in place of the ids."""
    pieces = cut(docs, tokenizer, text, key, longest, end).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return _in_order(number(written(pieces, "pieces")), key, "ids_crc32")
