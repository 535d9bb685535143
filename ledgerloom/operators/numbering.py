"""Consecutive numbers in a given order without bringing the rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import settle


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with numbers from 1 in the order of ``order``. Rows are dealt by range; each range starts after the
    rows of those before it, of which there are as many as partitions."""
    dealt = settle(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__rows"))
    upto = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__rows").over(upto), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    joined = dealt.join(F.broadcast(before), "__part")  # one row per partition
    return joined.withColumn(name, F.col("__before") + within).drop("__part", "__before")
