"""Ranking metrics over tables of judgements and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseek.operators.spread import spread_rank


def _judged(qrels: DataFrame) -> DataFrame:
    return qrels.filter(F.col("query_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("query_id", "doc_id").agg(F.max(F.coalesce("grade", F.lit(0.0))).alias("grade"))


def query_metrics(run: DataFrame, qrels: DataFrame, ks: list[int], exponential: bool = False, by: str | None = None) -> DataFrame:
    """``query_id, k, ndcg, mrr, recall, map`` of every judged query at every positive ``k``.

    run: ``query_id, doc_id, score``; qrels: ``query_id, doc_id, grade``. Queries without judgement are ignored, judged
    queries without results count as zero. NaN scores sort last, ties by rising doc id; negative grades count as zero;
    of repeated rows the best counts. With ``by``, a column of the run, several runs are measured in one plan.
    """
    judged = _judged(qrels)
    ks = [k for k in ks if k >= 1]
    at = F.explode(F.array(*[F.lit(k) for k in ks])) if ks else F.explode(F.array().cast("array<int>"))
    names = [by] if by else []
    gain = (lambda g: F.pow(F.lit(2.0), F.greatest(g, F.lit(0.0))) - 1) if exponential else (lambda g: F.greatest(g, F.lit(0.0)))
    s = F.when(F.isnan("score") | F.col("score").isNull(), F.lit(float("-inf"))).otherwise(F.col("score"))
    one = run.groupBy(*names, "query_id", "doc_id").agg(F.max(s).alias("score"))
    of_run = Window.partitionBy(*names, "query_id")
    ranked = one.withColumn("rank", F.row_number().over(of_run.orderBy(F.desc("score"), "doc_id")))
    hits = ranked.join(judged, ["query_id", "doc_id"]).withColumn("g", gain(F.col("grade"))).withColumn("rel", (F.col("grade") > 0).cast("int"))
    hits = hits.withColumn("so_far", F.sum("rel").over(of_run.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    got = hits.withColumn("k", at).filter(F.col("rank") <= F.col("k")).groupBy(*names, "query_id", "k").agg(
        F.sum(F.col("g") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum("rel").alias("found"),
        F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank"))).alias("precisions"),
    )
    ideal = judged.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).withColumn("g", gain(F.col("grade")))
    best = ideal.withColumn("k", at).groupBy("query_id", "k").agg(F.sum(F.when(F.col("i") <= F.col("k"), F.col("g") / F.log2(F.col("i") + 1))).alias("idcg"), F.count_if(F.col("grade") > 0).alias("positives"))
    if by:
        runs = [r[by] for r in run.select(by).distinct().collect()]  # the runs that are compared, few by their nature
        best = best.withColumn(by, F.explode(F.array(*[F.lit(r) for r in runs])) if runs else F.lit(None).cast(dict(run.dtypes)[by]))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return best.join(got, [*names, "query_id", "k"], "left").select(
        *names,
        "query_id",
        "k",
        F.round(zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))), 8).alias("ndcg"),
        F.round(zero(1 / F.col("first")), 8).alias("mrr"),
        F.round(zero(F.when(F.col("positives") > 0, F.col("found") / F.col("positives"))), 8).alias("recall"),
        F.round(zero(F.when(F.col("positives") > 0, F.col("precisions") / F.col("positives"))), 8).alias("map"),
    )


def macro_metrics(run: DataFrame, qrels: DataFrame, ks: list[int], exponential: bool = False, by: str | None = None) -> DataFrame:
    """``k, ndcg, mrr, recall, map, queries``: means over all judged queries, of each run of ``by``."""
    per = query_metrics(run, qrels, ks, exponential, by)
    means = [F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "mrr", "recall", "map")]
    return per.groupBy(*([by] if by else []), "k").agg(*means, F.count(F.lit(1)).alias("queries"))


def run_coverage(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row of audit counts: judged queries, those with results, run queries without judgement, and so on."""
    j = _judged(qrels)
    jq, rq = j.select("query_id").distinct().withColumn("j", F.lit(1)), run.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    both = jq.join(rq, "query_id", "full_outer")
    docs = run.select("query_id", "doc_id").distinct().join(j.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    a = both.agg(
        F.count_if(F.col("j").isNotNull()).alias("judged_queries"),
        F.count_if(F.col("j").isNotNull() & F.col("n").isNotNull()).alias("answered_queries"),
        F.count_if(F.col("j").isNotNull() & F.col("n").isNull()).alias("empty_queries"),
        F.count_if(F.col("j").isNull()).alias("unjudged_queries"),
    )
    b = docs.agg(F.count(F.lit(1)).alias("retrieved"), F.count_if(F.col("grade") > 0).alias("retrieved_relevant"))
    return a.crossJoin(b)  # one row each


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of ``value`` per group, of any size; nulls and NaN do not count, nor do rows with a null group."""
    real = F.col(value).isNotNull() & ~F.isnan(value)
    for c in by:
        real = real & F.col(c).isNotNull()
    ranked = spread_rank(rows.filter(real).select(*by, value), by, [F.col(value)], "_r")
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_r_of")))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("_r") == at(p), F.col(value))).alias(name) for name, p in shares.items()])


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``rho``: the correlation of average ranks. Equal values share the mean of their ranks."""

    def mean_ranks(df: DataFrame, c: str) -> DataFrame:
        # ranks over many partitions; the order among equal values does not change their mean
        return spread_rank(df.select(c), [], [F.col(c)]).groupBy(c).agg(F.avg("rank").alias(f"r_{c}"))

    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.join(mean_ranks(both, x), x).join(mean_ranks(both, y), y).agg(F.round(F.corr(f"r_{x}", f"r_{y}"), 6).alias("rho"))


def restricted(run: DataFrame, allowed: DataFrame) -> DataFrame:
    """The results of a run that are among the allowed ``query_id, doc_id``."""
    return run.join(allowed.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")


def unknown_ids(run: DataFrame, corpus: DataFrame) -> DataFrame:
    """``doc_id`` that a run returned though the corpus has none such; a sound run has no rows here."""
    return run.select("doc_id").distinct().join(corpus.select("doc_id").distinct(), "doc_id", "left_anti")
