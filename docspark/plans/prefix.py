"""Running sums over sorted rows without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.plans.storage import written

#: Sizes of ranges are broadcast up to so many.
BROADCAST_ROWS = 200_000


def running_sums(df: DataFrame, key: str, order: str, value: str, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``key`` that come before in ``order`` (unique in a key).

    Rows are sorted into ranges by key and order and written; sums within a range are a window, and each range
    adds the totals of its key in the ranges before it. A key that holds most rows is spread over ranges.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, key, order).sortWithinPartitions(key, order).withColumn("_range", F.spark_partition_id())
    placed = written(placed, "ranges")
    sizes = placed.groupBy(key, "_range").agg(F.sum(value).alias("_size"))
    earlier = F.sum("_size").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    within = F.sum(value).over(Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("_within", F.coalesce(within, F.lit(0)))
    return placed.join(sizes, [key, "_range"]).withColumn(name, F.col("_earlier") + F.col("_within")).drop("_range", "_earlier", "_within")
