"""Rows that have no number of their own, told apart by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import as_row, spread

#: Rows (some 50 bytes each) up to which a list of rows is broadcast. Beyond it a
#: join is left to the planner, which splits skewed keys at run time.
FEW = 500_000


def row_hash(df: DataFrame) -> Column:
    """64 bits of all columns of a row, but for maps and variants, which have no hash."""
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(F.lit(len(hashable)), *hashable)


def narrow(df: DataFrame) -> DataFrame:
    """``df``, whose rows are some numbers where the tables around it hold texts, in a sixteenth of a shuffle's partitions.

    Only for what comes out of a shuffle and does little after it.
    """
    return df.coalesce(max(1, spread(df.sparkSession) // 16))


def if_few(df: DataFrame) -> DataFrame:
    """Written ``df``, marked for broadcast if its rows are counted to be few."""
    return F.broadcast(df) if df.count() <= FEW else df


def without(rows: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """The column row of ``rows`` (id, tie, row) that ``gone`` doesn't name; of those that ``repeated`` names one each.

    ``gone`` and ``repeated`` are written tables of id and tie, a row once.
    """

    def named(df: DataFrame, how: str, list_: DataFrame) -> DataFrame:
        other = list_.select(F.col("id").alias("other_id"), F.col("tie").alias("other_tie"))
        return df.join(if_few(other), (F.col("tie") == F.col("other_tie")) & F.col("id").eqNullSafe(F.col("other_id")), how)

    kept = rows if gone.isEmpty() else named(rows, "left_anti", gone)
    if repeated.isEmpty():
        return kept.select("row.*")
    once = named(kept, "left_semi", repeated).groupBy("id", "tie").agg(F.first("row").alias("row"))
    return named(kept, "left_anti", repeated).select("row.*").unionByName(once.select("row.*"))


def identified(df: DataFrame, key: str, *more: Column) -> DataFrame:
    """id, tie and row of each row of ``df``, after the columns of ``more``."""
    return df.select(*more, F.col(key).alias("id"), row_hash(df).alias("tie"), as_row(df).alias("row"))
