"""Places of rows in an order, without putting all rows of a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with _n, their place from 0 in their group in this order.

    Rows are dealt to ranges of (group, order) and numbered there; how many rows of a group lie in the ranges before is a table of a row for each range and group.
    """
    ranged = written(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range", group).orderBy(*order)
    sizes = ranged.groupBy("_range", group).agg(F.count("*").alias("_size"))
    before = sizes.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), F.coalesce(F.sum("_size").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_k", F.row_number().over(own) - 1)
    return local.join(before, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn("_n", F.col("_before") + F.col("_k")).drop("_range", "_k", "_r", "_g", "_before")
