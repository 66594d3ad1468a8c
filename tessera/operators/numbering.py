"""Row numbers in an order, without one task for all rows or for all rows of a hot group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import stage


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with ``name``, the 0-based place within ``group`` (all rows if empty) by ``order``, nulls first.

    Rows are dealt to ranges of (group, order) and written, so each holds a
    neighbouring piece of the order. They are numbered within their range and
    moved up by the sizes of earlier ranges of their group. Only a group that
    spans ranges is moved, so the offsets are fewer than the ranges. The order
    should tell all rows apart; rows that it doesn't, of any number, meet in one range.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(ranges, *group, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*group, "range_no").agg(F.count("*").alias("range_rows"))
    if group:
        before = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    else:  # one row a range
        before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.withColumn("range_before", F.sum("range_rows").over(before)).where("range_before > 0")
    keys = [F.col(f"m_{c}").eqNullSafe(F.col(c)) for c in [*group, "range_no"]]
    offsets = F.broadcast(moved.select(*(F.col(c).alias(f"m_{c}") for c in [*group, "range_no"]), "range_before"))
    own = F.row_number().over(Window.partitionBy(*group, "range_no").orderBy(*order)) - 1
    placed = dealt.withColumn("range_at", own).join(offsets, keys, "left")
    return placed.select(*df.columns, (F.coalesce("range_before", F.lit(0)) + F.col("range_at")).alias(name))
