"""The size of the Arrow batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to BATCH_BYTES: rows of whole texts or matrices would else make far larger ones, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(key)))
    if now < 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
