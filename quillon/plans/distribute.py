"""Positions of rows in a global order, without one task for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """df with position, from 0 in the given order: rows are dealt by range, ranked inside their range, and moved by the sizes of the ranges before.

    The bounds of ranges come from a sample, so the dealt rows are fixed before both uses of them: in the folder of spark.checkpoint.dir
    where that is set (lost executors then lose nothing), else in memory and on local disk.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    dealt = dealt.checkpoint() if spark.sparkContext.getConf().get("spark.checkpoint.dir") else dealt.persist()
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return ranked.join(F.broadcast(before.drop("_n")), "_range").withColumn("position", F.col("_rank") + F.col("_before")).drop("_range", "_rank", "_before")
