"""Dense numbers in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmark.runtime import Scratch


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with ``name``, 0, 1, ... in the given order. The parts of a range partitioning are written
    once, then numbered inside, and shifted by the sizes of those before."""
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *(c.alias(k) for c, k in zip(order, keys)))
    parted = keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    parted = Scratch(df.sparkSession, "numbered").keep(parted, "parted")
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__c"))
    before = sizes.select("__part", (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return parted.withColumn("__r", at).join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__r") - 1).cast("long").alias(name))
