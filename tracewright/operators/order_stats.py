"""Numbers and quantiles of sorted values without one task that holds them all.

Values are counted, dealt out by range and sorted in their ranges, and written once; the counts of the ranges, a row a
range, give each range its offset, and running counts inside a range do the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import kept


def ranked_values(values: DataFrame, col: str) -> DataFrame:
    """(value, n, number, before): each distinct value of ``col``, how often it comes, its number from 1, and how many rows sort before it."""
    counted = values.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).repartitionByRange("value").withColumn("range", F.spark_partition_id())
    counted = kept(counted, "ranges")
    sizes = counted.groupBy("range").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range, as many as shuffle partitions
    offsets = sizes.select("range", F.coalesce(F.sum("values").over(w), F.lit(0)).alias("v"), F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("r"))
    inside = Window.partitionBy("range").orderBy("value")
    rows = counted.withColumn("at", F.row_number().over(inside)).withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(F.broadcast(offsets), "range").select("value", "n", (F.col("v") + F.col("at")).alias("number"), (F.col("r") + F.coalesce("upto", F.lit(0))).alias("before"))


def upper_median(values: DataFrame, col: str) -> DataFrame:
    """(rows, median): of n values that are not null, the one at place n // 2 in order, from 0; null of none."""
    ranked = ranked_values(values.where(F.col(col).isNotNull()), col)
    total = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    half = F.floor(F.col("rows") / 2)
    found = ranked.join(F.broadcast(total), (F.col("before") <= half) & (half < F.col("before") + F.col("n"))).select("rows", F.col("value").alias("median"))
    return total.join(F.broadcast(found), "rows", "left")
