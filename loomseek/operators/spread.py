"""Exact ranks within groups of any size.

A window ranks each group in one task. Where a group may hold a large share of all rows, the rows are
range-partitioned by group and order instead: a large group spreads over many partitions, is ranked inside each, and the
rows of its earlier partitions are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseek.session import staged


def spread_rank(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the rank (from 1) of each row in its group and ``<name>_of``, the group's rows.

    The order must be total within a group, and the ``by`` columns must not be null.
    """
    placed = staged(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))  # without ``by``: one group
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    offsets = counts.select(*by, "_part", (F.sum("_n").over(group.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias(f"{name}_of"))
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    ranked = placed.withColumn("_local", local).join(offsets, [*by, "_part"])
    return ranked.withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint")).drop("_part", "_local", "_before")


def spread_median(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """``by, median``: the exact median per group, the mean of the middle two for an even number. ``tie`` makes the order total."""
    ranked = spread_rank(df.select(*by, value, tie), by, [F.col(value), F.col(tie)], "_r")
    middle = (F.col("_r") >= F.floor((F.col("_r_of") + 1) / 2)) & (F.col("_r") <= F.ceil((F.col("_r_of") + 1) / 2))
    return ranked.filter(middle).groupBy(*by).agg(F.avg(value).alias("median"))
