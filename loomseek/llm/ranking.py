"""Problem 4: one ranking from several differently-scaled scores.

Method: robust standardisation by median and median absolute deviation per query and signal, logistic
squashing to the open interval (0, 1), and a weighted geometric mean of the bounded values. No
signal rules by its range, and an outlier is worth no more than a value of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseek.operators.spread import spread_median, spread_rank
from loomseek.session import staged

#: Weights of the signals; others count as DEFAULT_WEIGHT.
WEIGHTS = {"dense": 1.0, "sparse": 0.5, "structural": 0.25, "rerank": 1.0}
DEFAULT_WEIGHT = 0.5
#: Weight of the middle value 0.5 in every mean: a chunk that few signals know is drawn towards the middle.
PRIOR_WEIGHT = 1.0
#: Makes the deviation of a normal distribution its standard deviation.
CONSISTENCY = 1.4826
#: Rows of a query up to which it is computed in one partition. Both ways are exact.
TOGETHER = 500_000


def _clean(ranked: DataFrame) -> DataFrame:
    """The real scores, without their nulls; of repeated rows the greatest score counts."""
    real = F.col("score").isNotNull() & ~F.isnan("score") & F.col("query_id").isNotNull() & F.col("signal").isNotNull() & F.col("chunk_id").isNotNull()
    return ranked.filter(real).select("query_id", "signal", "chunk_id", F.col("score").cast("double").alias("score"))


def _by_size(clean: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of queries of up to ``bound`` rows, all rows of a query in one partition, and those of larger queries, if any."""
    large = clean.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound).select("query_id")
    together = clean.repartition("query_id")
    if large.isEmpty():
        return together, None
    large = staged(large)
    return together.join(large, "query_id", "left_anti"), staged(clean.join(large, "query_id", "left_semi"))


def _unit() -> Column:
    return F.when(F.col("mad") > 0, F.lit(CONSISTENCY) * F.col("mad")).when(F.col("mean_off") > 0, F.lit(1.2533) * F.col("mean_off"))


def _finite(score: str) -> Column:
    return F.when(F.abs(score) < F.lit(float("inf")), F.col(score))


def _clamped() -> Column:
    return F.coalesce(F.greatest(F.col("low"), F.least(F.col("high"), F.col("score"))), F.lit(0.0))


_OUT = ["query_id", "signal", "chunk_id", "score", "z", "bounded"]


def _finished(d: DataFrame) -> DataFrame:
    return d.withColumn("z", F.coalesce((F.col("score") - F.col("mid")) / _unit(), F.lit(0.0))).withColumn("bounded", squash(F.col("z"))).select(*_OUT)


def _in_place(rows: DataFrame) -> DataFrame:
    """``standardised`` of rows that lie together by query: one sort, no further exchange."""
    w = Window.partitionBy("query_id", "signal")
    one = rows.groupBy("query_id", "signal", "chunk_id").agg(F.max("score").alias("score"))
    one = one.withColumn("high", F.max(_finite("score")).over(w)).withColumn("low", F.min(_finite("score")).over(w)).withColumn("score", _clamped())
    off = one.withColumn("mid", F.median("score").over(w)).withColumn("off", F.abs(F.col("score") - F.col("mid")))
    return _finished(off.withColumn("mad", F.median("off").over(w)).withColumn("mean_off", F.avg("off").over(w)))


def _spread(rows: DataFrame) -> DataFrame:
    """``standardised`` of queries of any size: medians by rank, no task holds a whole query."""
    by = ["query_id", "signal"]
    one = rows.groupBy(*by, "chunk_id").agg(F.max("score").alias("score"))
    ends = one.groupBy(*by).agg(F.max(_finite("score")).alias("high"), F.min(_finite("score")).alias("low"))
    one = staged(one.join(ends, by).withColumn("score", _clamped()).select(*by, "chunk_id", "score"))
    centre = spread_median(one, by, "score", "chunk_id").withColumnRenamed("median", "mid")
    off = staged(one.join(centre, by).withColumn("off", F.abs(F.col("score") - F.col("mid"))))
    spread = spread_median(off, by, "off", "chunk_id").withColumnRenamed("median", "mad").join(off.groupBy(*by).agg(F.avg("off").alias("mean_off")), by)
    return _finished(off.join(spread, by))


def standardised(ranked: DataFrame, together: int = TOGETHER) -> DataFrame:
    """``query_id, signal, chunk_id, score, z, bounded``.

    A deviation of zero (more than half of the scores tie) falls back on the mean absolute deviation, and where
    that is zero too all scores are equal and get the middle, 0.5. Null and NaN scores are no scores; infinite ones
    count as the largest or smallest finite score of their query and signal; of repeated rows the
    greatest score counts. Queries of up to ``together`` rows are computed in one partition each, larger ones by ranks over many
    partitions, with the same result.
    """
    small, large = _by_size(_clean(ranked), together)
    return _in_place(small) if large is None else _in_place(small).unionByName(_spread(large))


def squash(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _fused(bounded: DataFrame, weights: dict[str, float], prior: float) -> DataFrame:
    w = F.lit(DEFAULT_WEIGHT)
    for k, v in weights.items():
        w = F.when(F.col("signal") == k, F.lit(float(v))).otherwise(w)
    per = bounded.withColumn("w", w).groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.ln("bounded")).alias("s"), F.sum("w").alias("all_w"), F.count(F.lit(1)).alias("n_signals"))
    score = F.round(F.exp((F.col("s") + F.lit(float(prior)) * F.ln(F.lit(0.5))) / (F.col("all_w") + F.lit(float(prior)))), 9)
    return per.select("query_id", "chunk_id", score.alias("final_score"), "n_signals")


def fused_ranking(ranked: DataFrame, weights: dict[str, float] = WEIGHTS, prior: float = PRIOR_WEIGHT, together: int = TOGETHER) -> DataFrame:
    """``query_id, chunk_id, final_score, rank, n_signals``: one order per query.

    ``final_score`` is the weighted geometric mean of the bounded scores the chunk has and of the middle value with
    weight ``prior``. A signal that the chunk or the query lacks does not count: signals are missing for reasons of
    their own, so a missing one is no bad one, but less is known of the chunk. Ties are ordered by chunk
    id, ranks count from 1. A query without any real score has no rows. The rows move once, by query; only queries of more
    than ``together`` rows are spread further.
    """
    small, large = _by_size(_clean(ranked), together)
    order = [F.desc("final_score"), F.col("chunk_id")]
    out = _fused(_in_place(small), weights, prior).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    if large is not None:
        out = out.unionByName(spread_rank(_fused(_spread(large), weights, prior), ["query_id"], order).select(*out.columns[:-1], F.col("rank").cast("int").alias("rank")))
    return out.select("query_id", "chunk_id", "final_score", "rank", "n_signals")


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """``ndcg`` of a run (``query_id, chunk_id, rank``) at ``k``, averaged over the judged queries with a relevant chunk."""
    judged = qrels.filter(F.col("grade") > 0).groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id")
    ideal = judged.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= k).groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("i") + 1)).alias("ideal"))
    got = run.filter(F.col("rank") <= k).join(judged, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("gain"))
    return ideal.join(got, "query_id", "left").agg(F.round(F.avg(F.coalesce(F.col("gain"), F.lit(0.0)) / F.col("ideal")), 6).alias("ndcg"), F.count(F.lit(1)).alias("queries"))
