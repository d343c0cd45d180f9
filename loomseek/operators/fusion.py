"""Weighted reciprocal rank fusion and its explanation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signals in the order that breaks ties.
SIGNALS = ["dense", "sparse", "structural"]


def _by_signal(values: dict, default: float = 0.0) -> Column:
    return reduce(lambda c, kv: F.when(F.col("signal") == kv[0], F.lit(float(kv[1]))).otherwise(c), values.items(), F.lit(default))


def best_ranks(ranked: DataFrame, signals: list[str] | None = None) -> DataFrame:
    """``query_id, signal, chunk_id, rank``: repeats keep the best rank, unknown signals and ranks below 1 are dropped."""
    ok = F.col("signal").isin(*(signals or SIGNALS)) & (F.col("rank") >= 1) & F.col("query_id").isNotNull() & F.col("chunk_id").isNotNull()
    return ranked.filter(ok).groupBy("query_id", "signal", "chunk_id").agg(F.min("rank").alias("rank"))


def reranked(ranked: DataFrame) -> DataFrame:
    """Rank anew by score within query and signal, repeated rows once; ties by chunk id, no rank for null and NaN scores."""
    one = ranked.filter(F.col("score").isNotNull() & ~F.isnan("score")).groupBy("query_id", "signal", "chunk_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "signal").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return one.withColumn("rank", F.row_number().over(order))


Weights = dict[str, float] | DataFrame


def present_weights(ranks: DataFrame, weights: Weights, renormalise: bool = True) -> DataFrame:
    """``query_id, signal, w``: weights of the signals a query has; a signal of weight zero does not count.

    ``weights`` are those of all queries, or a table ``query_id, signal, w``.
    """
    have = ranks.select("query_id", "signal").distinct()
    have = have.withColumn("w", _by_signal(weights)) if isinstance(weights, dict) else have.join(weights, ["query_id", "signal"])
    have = have.filter(F.col("w") > 0)
    return have.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))) if renormalise else have


def rrf(ranked: DataFrame, weights: Weights, rrf_k: int = 60, renormalise: bool = True, signals: list[str] | None = None) -> DataFrame:
    """``query_id, chunk_id, rrf_score, contributions, dominant_signal, rank``.

    The score is the sum of ``w / (rrf_k + rank)`` over the signals; contributions map a signal to its rank; the dominant
    signal gives the largest term, ties in the order of SIGNALS.
    """
    ranks = best_ranks(ranked, signals)
    terms = ranks.join(present_weights(ranks, weights, renormalise), ["query_id", "signal"]).withColumn("term", F.col("w") / (F.lit(rrf_k) + F.col("rank")))
    ordinal = _by_signal({s: i for i, s in enumerate(signals or SIGNALS)}, 99.0)
    fused = terms.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum("term"), 9).alias("rrf_score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "rank")))).alias("contributions"),
        F.max_by("signal", F.struct(F.round("term", 12), -ordinal)).alias("dominant_signal"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order))


def rrf_terms(ranked: DataFrame, weights: Weights, rrf_k: int = 60) -> DataFrame:
    """The terms a fused score is made of: ``query_id, chunk_id, signal, rank, weight, term``."""
    ranks = best_ranks(ranked)
    return ranks.join(present_weights(ranks, weights), ["query_id", "signal"]).select("query_id", "chunk_id", "signal", "rank", F.round("w", 9).alias("weight"), F.round(F.col("w") / (F.lit(rrf_k) + F.col("rank")), 9).alias("term"))


def merge_lists(lists: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Merges the lists of sub-queries or versions: ``query_id, signal, chunk_id, score, rank``.

    lists: ``query_id, signal, list_id, chunk_id, score, rank``. A query and signal with one list that is not
    empty keeps its scores; of several, the score is the sum of ``1 / (rrf_k + rank)``. A ``reason`` stays with its chunk.
    """
    n = F.size(F.collect_set("list_id").over(Window.partitionBy("query_id", "signal")))
    marked = lists.withColumn("n_lists", n)
    more = [F.max("reason").alias("reason")] if "reason" in lists.columns else []
    merged = marked.groupBy("query_id", "signal", "chunk_id").agg(
        F.when(F.max("n_lists") == 1, F.max("score")).otherwise(F.sum(1 / (F.lit(rrf_k) + F.col("rank")))).alias("score"), *more
    )
    order = Window.partitionBy("query_id", "signal").orderBy(F.desc("score"), "chunk_id")
    return merged.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order))


def weight_sweep(ranked: DataFrame, qrels: DataFrame, sparse_weights: list[float], k: int = 10) -> DataFrame:
    """NDCG of the fusion for each sparse weight, in one plan: ``sparse_weight, ndcg``. The ranks are folded once for all weights."""
    from loomseek.operators.metrics import macro_metrics

    ranks = best_ranks(ranked, ["dense", "sparse"])
    term = lambda signal: F.coalesce(F.max(F.when(F.col("signal") == signal, 1 / (F.lit(60) + F.col("rank")))), F.lit(0.0))
    per = ranks.groupBy("query_id", F.col("chunk_id").alias("doc_id")).agg(term("dense").alias("dense"), term("sparse").alias("sparse"))
    run = per.withColumn("sparse_weight", F.explode(F.array(*[F.lit(float(w)) for w in sparse_weights])))
    run = run.withColumn("score", F.round((1 - F.col("sparse_weight")) * F.col("dense") + F.col("sparse_weight") * F.col("sparse"), 9)).filter(F.col("score") > 0)
    return macro_metrics(run, qrels, [k], by="sparse_weight").select("sparse_weight", "ndcg")
