"""Bounded, repeatable samples of labelled rows, and held-out folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.scratch import written

#: Bounds of a training sample: classes, and rows of all of them.
MOST_CLASSES = 256
ROWS = 10_000
#: Parts of the hashes' range in which a class is ranked.
STRETCHES = 64


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def sample_per_class(labelled: DataFrame, per_class: int, seed: int = 1) -> DataFrame:
    """At most ``per_class`` rows of each class of ``labelled`` (key, label), those of least hash.

    ``labelled`` has an id once. The rows come with ``half``, 0 or 1, which splits
    the sample for two uses, and ``weight``, the number of labelled rows of the
    class for each one in the sample. Of more than MOST_CLASSES classes those with
    the most rows are sampled, and with many classes each gives fewer rows, so
    that there are ROWS at most.

    No row moves before its class has been thinned by hash where it lies, to about
    twice the wanted number. What is left is ranked in stretches of the hash, so
    that no class meets in one task.
    """
    hashed = labelled.select("key", "label", (F.xxhash64("key", F.lit(seed)) / 2.0**64 + 0.5).alias("share"), F.xxhash64("key", F.lit(seed)).alias("hash"))
    counts = written(hashed.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MOST_CLASSES), "classes")
    classes = max(1, counts.count())
    most = max(1, min(per_class, ROWS // classes))
    # the share of hashes that leaves about twice the wanted number
    limits = counts.withColumn("limit", F.least(F.lit(1.0), 2.0 * most / F.col("n")))
    thin = written(
        hashed.join(F.broadcast(limits), "label")  # MOST_CLASSES rows at most
        .filter(F.col("share") < F.col("limit"))
        .withColumn("stretch", F.floor(F.col("share") / F.col("limit") * STRETCHES))
        .drop("share", "limit"),
        "thinned",
    )
    upto = Window.partitionBy("label").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = thin.groupBy("label", "stretch").count().select("label", "stretch", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy("label", "stretch").orderBy("hash", "key")
    ranked = thin.join(F.broadcast(before), ["label", "stretch"]).withColumn("rank", F.col("before") + F.row_number().over(inside))
    picked = ranked.filter(F.col("rank") <= most)
    return written(picked.select("key", "label", F.pmod("hash", F.lit(2)).alias("half"), F.greatest(F.lit(1.0), F.col("n") / most).alias("weight")), "sample")


def prior_shift(positive: np.ndarray, weight: np.ndarray) -> float:
    """What a log odds learned from rows of a sample lacks: that of all labelled rows less the sample's."""
    if positive.all() or not positive.any():
        return 0.0
    return float(np.log(weight[positive].mean() / weight[~positive].mean()))


def sampled_texts(docs: DataFrame, sample: DataFrame, text: str, key: str, longest: int | None = None) -> DataFrame:
    """The documents of the sample: key, text, label, half, weight, of which ``text`` is cut by :func:`bounded` if told so.

    The sample is bounded and is broadcast. Of documents that repeat an id one is
    taken, the least of their texts, so there is a row for each of the sample at most.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(F.col(key).alias("key"), (bounded(whole, longest) if longest else whole).alias("text")).join(F.broadcast(sample), "key")
    return found.groupBy("key", "label", "half", "weight").agg(F.min("text").alias("text"))


def bounded(text: Column, longest: int, stretches: int = 4) -> Column:
    """The text, or of one of more than ``longest`` characters that many at most, in stretches spread over all of it."""
    size = (longest - stretches + 1) // stretches
    last = F.length(text) - size
    parts = [F.substring(text, (F.floor(last * k / (stretches - 1)) + 1).cast("int"), F.lit(size)) for k in range(stretches)]
    return F.when(F.length(text) <= longest, text).otherwise(F.concat_ws(" ", *parts))


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """key, label; of several labels of an id the largest, rows with a null left out."""
    some = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    return some.groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
