"""Running totals over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.plans.lineage import materialize


def running_totals(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds for each ``into: column`` of sums the total of all rows up to and including the row, in the order of a column with distinct values.

    Rows are range-partitioned and written once; each partition adds up its own
    rows, and the totals of the partitions before it, one row a partition, are joined to it.
    """
    ranged = materialize(df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy(F.col("__part").alias("__before")).agg(*(F.sum(c).alias(f"__t_{into}") for into, c in sums.items()))
    before = Window.orderBy("__before").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__before", *(F.coalesce(F.sum(f"__t_{into}").over(before), F.lit(0)).alias(f"__b_{into}") for into in sums))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(F.broadcast(bases), F.col("__part") == F.col("__before"))  # as many rows as partitions
    return joined.withColumns({into: F.sum(c).over(inside) + F.col(f"__b_{into}") for into, c in sums.items()}).drop("__part", "__before", *(f"__b_{into}" for into in sums))
