"""Mixing sources to target weights.

A document's size is its number of words. The sources, by code point with null
last, take the weights in turn. The sum of all sizes is shared by weight; a
source's target stops at ``most`` times its own size and the excess is shared
by weight among the others until none is above. A document of a source with
rate r = target / source size is emitted floor(r) times, plus once more with
the probability r - floor(r) by a hash of its id and the seed, so reruns agree
and no state is kept.

Only DataFrame functions are used. Sizes are summed per source before any
shuffle of note, so a source with a third of all rows is one row per task.
The targets need the sources in order of size / weight; that order is global
but dealt by range (see ``prefix_sums``).

Defined results: a null text has size 0, a very long one is counted whole; a
null source is a source of its own; a source of size 0 has target and rate 0;
ids need not be unique: rows with the same id draw the same number, a null id
draws as the empty string. An empty table gives an empty result. Other columns
are untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import as_row, prefix_sums, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240607
#: Sources up to which their table (some 100 bytes a row) is broadcast; beyond
#: it the join is left to the planner, which splits skewed sources at run time.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def product(a: str, b: str) -> Column:
    """Exact: a corpus' words times its sources' weights may leave 64 bits."""
    return F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(18,0)")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target and rate, from rows of source and size."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.col("source").isNull(), F.col("source")]
    per = written(per, "per-source")
    ranked = prefix_sums(per, by_name, {"rank": F.lit(1)}, "sources")
    cycle = F.array(*map(F.lit, weights))
    weighted = ranked.withColumn(
        "weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")).cast("long")
    ).withColumn("cap", F.col("source_size") * most)
    # In order of cap / weight the sources that stop at their cap come first.
    # capped, left: caps of those before a source, weights of it and those after.
    filling = prefix_sums(
        weighted,
        [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")],
        {"capped": F.col("cap"), "passed": F.col("weight")},
        "filling",
    )
    whole = per.agg(F.sum("source_size").alias("whole"))
    weight = weighted.agg(F.sum("weight").alias("all_weights"))
    level = (
        filling.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(weight))  # one row each
        .withColumn("money", F.col("whole") - F.col("capped"))
        .withColumn("left", F.col("all_weights") - F.col("passed"))
        .withColumn("above", product("cap", "left") >= product("weight", "money"))
    )
    # The first source that its share does not lift above its cap sets the level.
    first = level.filter("above").agg(F.min_by(F.struct("money", "left"), F.struct("passed", "capped")).alias("level"))
    share = product("weight", "level.money").cast("double") / F.col("level.left")
    target = F.when(F.col("level").isNull() | (product("cap", "level.left") < product("weight", "level.money")), F.col("cap").cast("double")).otherwise(share)
    return (
        weighted.crossJoin(F.broadcast(first))
        .withColumn("target", target)
        .select(
            "source",
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        )
    )


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id and the seed."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs``, which has the column source, with the columns of ``rates`` as the struct rate."""
    named = written(rates, "rates").select(F.struct("*").alias("rate"))
    if named.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    return docs.join(named, F.col("source").eqNullSafe(F.col("rate.source")))


def plan_mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: its size, its source's size and target, the words taken."""
    sizes = written(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")),
        "sizes",
    )
    mixed = with_rates(sizes, targets(sizes, weights, most))
    return mixed.select(
        F.col("key").alias(key),
        "size",
        F.col("rate.source_size").alias("source_size"),
        F.col("rate.target").alias("target"),
        (F.col("size") * copies(F.col("rate.rate"), F.col("key"), seed)).alias("taken"),
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """The documents of the mix: each row of ``docs`` as often as it is taken."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), as_row(docs).alias("row"))
    rated = with_rates(rows.select("key", "source", "row"), targets(rows, weights, most))
    times = F.array_repeat(F.lit(0), copies(F.col("rate.rate"), F.col("key"), seed).cast("int"))
    return rated.select("row", F.explode(times).alias("copy")).select("row.*")
