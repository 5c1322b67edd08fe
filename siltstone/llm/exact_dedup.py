"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after each run of ASCII white space is
replaced by one space. A Misra-Gries summary per partition finds the digests
that may be frequent; the exact winners of those that are frequent form a table
of bounded size that is broadcast, so their copies are resolved on the map side
and never shuffled. All other digests have few copies each and go through one
ordinary shuffle.

Defined results: a null text counts as empty; empty texts are copies of each
other; a very long text is normalised and digested whole; of copies the smallest id stays, a null id comes last, and of rows that
repeat the winning id exactly one stays. An empty table gives an empty result.
Columns of the input other than the id and the text are never looked at, so
their names and nulls don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.rows import identified, narrow, without
from siltstone.scratch import written

#: A digest is heavy when it has at least this share of all rows.
HEAVY_SHARE = 1 / 2048
#: Counters of a Misra-Gries summary. A digest's summed count falls short of the
#: truth by at most rows / COUNTERS, so no heavy digest is missed, and at most
#: 1 / (HEAVY_SHARE - 1 / COUNTERS) digests (2731) become candidates.
COUNTERS = 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def misra_gries(counters: int):
    """A mapInArrow function: digests to (digest, least count) of one partition."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > counters:
                # the mergeable form: take the (counters + 1)-th count off all
                counts = np.fromiter(held.values(), np.int64, len(held))
                off = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
                held = {k: n - off for k, n in held.items() if n > off}
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                names=["digest", "least"],
            )

    return summarise


def heavy_digests(digests: DataFrame, share: float = HEAVY_SHARE, counters: int = COUNTERS) -> DataFrame:
    """The digests with at least ``share`` of the rows, their exact count and winner.

    ``digests`` has digest, key (any orderable column; the smallest wins). The
    result has at most ``1 / share`` rows.
    """
    rows = digests.count()
    least_rows = max(2, int(np.ceil(rows * share)))
    candidates = (
        digests.select("digest")
        .mapInArrow(misra_gries(counters), "digest binary, least long")
        .groupBy("digest")
        .agg(F.sum("least").alias("least"))
        .filter(F.col("least") >= max(1, least_rows - rows / counters))
        .select("digest")
    )
    return (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("key").alias("winner"), F.count("*").alias("copies"))
        .filter(F.col("copies") >= least_rows)
    )


def duplicate_groups(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    share: float = HEAVY_SHARE,
    counters: int = COUNTERS,
) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256."""
    rows = written(
        docs.select(
            F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.monotonically_increasing_id().alias("row")).alias("key"),
            digest(F.col(text)).alias("digest"),
        ),
        "digests",
    )
    heavy = written(heavy_digests(rows, share, counters), "heavy")
    group = Window.partitionBy("digest")
    by_map = rows.join(F.broadcast(heavy), "digest")
    by_shuffle = (
        rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
        .withColumn("winner", F.min("key").over(group))
        .withColumn("copies", F.count("*").over(group))
    )
    return by_map.unionByName(by_shuffle).select(
        F.col("key.id").alias(key),
        F.col("winner.id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("key.row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows that share the winning id the one of least hash stays, and of rows
    that are alike in all columns one. Only digests, ids and hashes are shuffled.
    Copies of heavy digests are dropped where they lie; the others that go are
    listed, and the list is broadcast if it is short, else joined.
    """
    named = identified(docs, key, digest(F.col(text)).alias("digest")).select("digest", F.struct(F.col("id").isNull().alias("none"), "id", "tie").alias("key"))
    light = written(named, "digests")
    heavy = written(heavy_digests(light), "heavy")
    rest = light.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("key").alias("winner"), F.count("*").alias("copies")).filter("copies > 1")
    gone = written(narrow(rest.join(groups, "digest").filter("key <> winner").select("key.id", "key.tie").distinct()), "gone")
    repeated = written(narrow(light.groupBy("key").count().filter("count > 1").select("key.id", "key.tie")), "repeated")
    rows = identified(docs, key, digest(F.col(text)).alias("digest"))
    same = F.col("id").eqNullSafe(F.col("winner.id")) & (F.col("tie") == F.col("winner.tie"))
    resolved = rows.join(F.broadcast(heavy), "digest", "left").filter(F.col("winner").isNull() | same)
    return without(resolved.select("id", "tie", "row"), gone, repeated)
