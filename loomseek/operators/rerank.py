"""Reranking of fused candidates, and the verdict whether a result is good enough."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.functions.text import lexical_terms
from loomseek.operators.ranks import top_ranked
from loomseek.settings import DEFAULT, Settings

# Saturation, share of the headroom for a verbatim phrase, and span of the logit.
K1, PHRASE, SPAN = 1.2, 0.35, 6.0
# Fixed value: the reference cuts documents here.
LONGEST = 4096


def lexical_similarity(q: Column, d: Column) -> Column:
    """Saturated coverage of the query's distinct terms, and a bonus where its terms stand in a row; in [0, 1].

    ``q`` and ``d`` are the terms of query and document. Give columns, not expressions: they are read once per query term.
    """
    distinct = F.array_distinct(q)
    counts = F.transform(distinct, lambda t: F.size(F.filter(d, lambda x: x == t)).cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n / (n + K1))
    cover = F.when(F.size(distinct) > 0, total / F.size(distinct)).otherwise(0.0)
    phrase = (F.size(q) > 0) & F.contains(F.array_join(d, " "), F.array_join(q, " "))
    return F.least(F.lit(1.0), F.when(phrase, cover + (1 - cover) * PHRASE).otherwise(cover))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))


def _head(document: str, longest: int | None) -> Column:
    return F.col(document) if longest is None else F.substring(F.col(document), 1, longest)


def lexical_rerank(pairs: DataFrame, query: str = "query_text", document: str = "text", longest: int | None = None) -> DataFrame:
    """``pairs`` with ``rerank_score`` over whole documents; ``longest`` is the reference's cut, in characters, and ``truncated`` says where it cut."""
    terms = pairs.withColumn("_q", lexical_terms(F.col(query))).withColumn("_d", lexical_terms(_head(document, longest)))
    scored = terms.withColumn("_sim", lexical_similarity(F.col("_q"), F.col("_d")))
    scored = scored.withColumn("rerank_score", F.round(sigmoid(F.lit(SPAN) * (2 * F.col("_sim") - 1)), 9)).drop("_q", "_d", "_sim")
    return scored if longest is None else scored.withColumn("truncated", F.coalesce(F.length(document) > longest, F.lit(False)))


def model_rerank(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], query: str = "query_text", document: str = "text", by: str = "query_id", longest: int | None = None) -> DataFrame:
    """``pairs`` with the ``rerank_score`` of a batch scorer of logits; a query with any NaN keeps its order (null scores).

    ``longest`` cuts the documents, in characters, for scorers that have a limit.
    """

    @F.pandas_udf(T.DoubleType())
    def score(q: pd.Series, d: pd.Series) -> pd.Series:
        return scorer(q, d)

    from pyspark.sql import Window

    scored = pairs.withColumn("_logit", score(F.col(query), _head(document, longest)))
    bad = F.max(F.isnan("_logit") | F.col("_logit").isNull()).over(Window.partitionBy(by))
    return scored.withColumn("rerank_score", F.when(~bad, F.round(sigmoid(F.col("_logit")), 9))).drop("_logit")


def final_order(candidates: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """Order by ``rerank_score``, where it is null by ``rrf_score``: ``final_score`` and ``rank``."""
    return top_ranked(candidates.withColumn("final_score", F.coalesce("rerank_score", "rrf_score")), k, ["query_id"], key, "final_score")


def sufficiency(results: DataFrame, queries: DataFrame, reranked: bool, settings: Settings = DEFAULT) -> DataFrame:
    """``query_id, top1, above_floor, sufficient`` of every query.

    On the scale of reciprocal ranks the threshold cannot be reached; there any result is enough.
    """
    score = "rerank_score" if reranked else "rrf_score"
    s = F.coalesce(F.col(score), F.lit(0.0))
    per = results.groupBy("query_id").agg(F.max(s).alias("top1"), F.count_if(s > settings.sufficiency_floor).cast("bigint").alias("above_floor"))
    unreachable = (not reranked) and settings.sufficiency_top1 > 1 / (settings.rrf_k + 1)
    good = F.lit(True) if unreachable else (F.col("top1") >= settings.sufficiency_top1) & (F.col("above_floor") >= settings.sufficiency_min)
    all_q = queries.select("query_id").distinct().join(per, "query_id", "left")
    return all_q.select("query_id", "top1", F.coalesce("above_floor", F.lit(0)).cast("bigint").alias("above_floor"), (F.col("top1").isNotNull() & good).alias("sufficient"))
