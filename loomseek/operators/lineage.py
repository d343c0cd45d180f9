"""Ancestors along a parent column, by pointer doubling.

The chain of a version is followed for all versions at once: each round joins the table of
unfinished pointers with itself and doubles the distance covered, so a chain of ``n`` parents
takes ``log2(n)`` joins. A parent that is unknown ends the chain; a cycle ends after the
bounded number of rounds and gives no ancestor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.session import staged


def nearest_ancestor(versions: DataFrame, keep: Column, group: str = "repo", key: str = "version_id", parent: str = "parent_version") -> DataFrame:
    """For every row its nearest ancestor for which ``keep`` holds.

    Returns ``group, key, ancestor, hops``; ``ancestor`` is null where there is none, ``hops`` the
    number of parent steps to it. Repeated rows count once, rows with a null key are dropped; of
    rows that share a key one for which ``keep`` holds comes first.
    """
    v = (
        versions.filter(F.col(key).isNotNull())
        .groupBy(F.col(group).alias("g"), F.col(key).alias("v"))
        .agg(F.max(F.coalesce(keep, F.lit(False))).alias("ok"), F.max(F.struct(F.coalesce(keep, F.lit(False)), F.col(parent)))[parent].alias("p"))
    )
    up = v.select(F.col("g"), F.col("v").alias("p"), F.col("ok").alias("p_ok"))
    link = v.join(up, ["g", "p"], "left").select(
        "g",
        "v",
        F.when(F.col("p_ok").isNotNull() & (F.col("p") != F.col("v")), F.col("p")).alias("to"),
        F.lit(1).alias("hops"),
        (F.col("p_ok").isNull() | F.col("p_ok") | (F.col("p") == F.col("v"))).alias("done"),
    )
    # written, not checkpointed: a checkpoint keeps the size estimate of its joins, which squares every round
    link = staged(link)
    # a chain without cycle is followed to its end in so many doublings
    for _ in range(link.count().bit_length() + 1):
        if link.filter(~F.col("done")).isEmpty():
            break
        ahead = link.select(F.col("g"), F.col("v").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"))
        link = staged(
            link.join(ahead, ["g", "to"], "left").select(
                "g",
                "v",
                F.when(F.col("done"), F.col("to")).otherwise(F.col("to2")).alias("to"),
                F.when(F.col("done"), F.col("hops")).otherwise(F.col("hops") + F.col("hops2")).alias("hops"),
                (F.col("done") | F.coalesce(F.col("done2"), F.lit(True))).alias("done"),
            )
        )
    return link.select(
        F.col("g").alias(group),
        F.col("v").alias(key),
        F.when(F.col("done"), F.col("to")).alias("ancestor"),
        F.when(F.col("done") & F.col("to").isNotNull(), F.col("hops")).alias("hops"),
    )

