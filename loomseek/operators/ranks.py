"""Ranked lists: one total order everywhere, by falling score and rising id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_ranked(scored: DataFrame, k: int, by: list[str], key: str = "chunk_id", score: str = "score", digits: int = 9) -> DataFrame:
    """The ``k`` best rows per ``by`` with contiguous ranks from 1.

    Scores are compared after rounding to ``digits``, so the order does not depend on the order of summation;
    ties go by ``key``. Null and NaN scores are never ranked.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("_s"), key)
    clean = scored.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn("_s", F.round(score, digits))
    return clean.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn(score, F.col("_s")).drop("_s")


def global_top(scored: DataFrame, k: int, key: str = "chunk_id", score: str = "score", digits: int = 9) -> DataFrame:
    """The ``k`` best rows of all, by falling score and rising ``key``: each partition keeps ``k``, no window is needed."""
    clean = scored.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn(score, F.round(score, digits))
    return clean.orderBy(F.desc(score), key).limit(k)


def canonical_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id and version, the first in the order of path, span, kind and symbol."""
    order = Window.partitionBy("repo", "version_id", "chunk_id").orderBy("file_path", "start_line", "start_byte", "end_byte", F.coalesce("kind", F.lit("")), F.coalesce("symbol", F.lit("")))
    return chunks.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def rank_movement(before: DataFrame, after: DataFrame, by: list[str], key: str = "chunk_id") -> DataFrame:
    """How far each item moved between two rankings: positive is up; null where it is in one only."""
    b = before.select(*by, key, F.col("rank").alias("first_rank"))
    return after.select(*by, key, F.col("rank").alias("final_rank")).join(b, [*by, key], "left").withColumn("moved", F.col("first_rank") - F.col("final_rank"))
