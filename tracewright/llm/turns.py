"""Positions of turns in their conversations, without a conversation's rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN = 4096  # turn numbers of one window group


def numbered(rows: DataFrame, key: str, turn: str, ties: list[str]) -> DataFrame:
    """Adds ``pos`` (from 1, by turn, nulls first, then ``ties``) and ``size`` (rows of the key).

    ``key`` must not be null. Windows run over SPAN turn numbers at a time; a small table of the
    counts of these spans gives each its offset. Only rows of one turn number can't be divided.
    """
    first = F.lit(-(2**63)).cast("long")
    rows = rows.withColumn("_span", F.coalesce(F.floor(F.col(turn) / SPAN), first))
    within = F.row_number().over(Window.partitionBy(key, "_span").orderBy(F.asc_nulls_first(turn), *ties))
    spans = rows.groupBy(key, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(key, "_span", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("size"))
    out = rows.withColumn("_at", within).join(spans, [key, "_span"])
    return out.withColumn("pos", F.col("_at") + F.col("_before")).drop("_at", "_before", "_span")


def ranges(lo: Column, hi: Column, name: str, df: DataFrame) -> DataFrame:
    """A row for each whole number from lo to hi, made SPAN at a time; none where hi < lo."""
    out = df.where(lo <= hi).withColumn("_b", F.explode(F.sequence(F.floor(lo / SPAN), F.floor(hi / SPAN))))
    return out.withColumn(name, F.explode(F.sequence(F.greatest(lo, F.col("_b") * SPAN), F.least(hi, (F.col("_b") + 1) * SPAN - 1)))).drop("_b")
