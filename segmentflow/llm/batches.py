"""Arrow batches of bounded bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
USUAL, SMALL = "67108864b", "8m"


def small_batches(spark: SparkSession) -> None:
    """Let tasks meet whole texts in batches of 8 MB, unless the session has a bound of its own.

    A batch is held by the JVM and by Python, several times while it is built; results do not depend on it.
    """
    if spark.conf.get(BYTES) == USUAL:
        spark.conf.set(BYTES, SMALL)
