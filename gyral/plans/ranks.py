"""Global ranks without a single sorting task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyral.session import cut


def global_rank(df: DataFrame, *order: str | Column, name: str = "rank", total: str | None = None) -> DataFrame:
    """df with the row's place, from 0, in the given order; `total` names a column for the row count.

    Rows are range-partitioned by the order and ranked within their partition; only the partitions' row counts, one row
    each, are summed in one place. The order should be unique; rows equal in it share a partition but not a place.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select("_part", before.alias("_before"), F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_total"))
    rows = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).join(F.broadcast(sums), "_part")
    rows = rows.withColumn(name, F.col("_before") + F.col("_n"))
    if total:
        rows = rows.withColumn(total, F.col("_total"))
    return rows.drop("_part", "_n", "_before", "_total", "_rows")


def group_rank(df: DataFrame, by: str, *order: str | Column, name: str = "place", size: str = "size") -> DataFrame:
    """df with the row's place in its group, from 0, and the group's size; a group may span many partitions."""
    ranked = cut(global_rank(df, by, *order, name="_place"), "ranked")
    groups = ranked.groupBy(by).agg(F.min("_place").alias("_first"), F.count("*").alias(size))
    return ranked.join(groups, by).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")
