"""Arrow batches by size in bytes, as rows of text may be long."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of a batch that goes to a Python worker. The default, 10,000 rows whatever
#: they hold, is some 35 MB of web text in every buffer on the way.
BYTES = 4 * 1024 * 1024


def by_bytes(df: DataFrame) -> DataFrame:
    """``df`` unchanged; from here on its session cuts batches by BYTES unless it was told a limit.

    Batches are cut when a plan runs, which is after the caller has got it, so the
    setting can't be taken back. A session that sets a limit of its own keeps it.
    """
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BYTES))
    return df
