"""How much goes to Python workers at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, about.
BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on, batches of at most BYTES bytes go to the session's Python workers, so that memory does not grow with the texts; a smaller limit is left alone."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key, "64m"))
    if not 0 < now <= BYTES:
        conf.set(key, str(BYTES))
    return df
