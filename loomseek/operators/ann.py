"""Approximate vector search by cells, for corpora where exact search costs too much.

Centres are fitted on a bounded sample (SAMPLE rows, the only thing fitted on less than all rows); every vector is
then assigned to its nearest centre, and a query looks into the cells nearest to it. Recall is measured
against exact search, see ``recall``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.operators.dense import _multiply, dense_topk
from loomseek.operators.ranks import top_ranked
from loomseek.session import staged

#: Rows that the centres are fitted on, and rounds of the fit.
SAMPLE = 20_000
ROUNDS = 12
#: Rows of a cell that one group multiplies; larger cells are split.
GROUP = 50_000


def fit_centres(vectors: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """``cells`` centres of at most SAMPLE rows, by k-means over inner products; deterministic."""
    rows = vectors.filter(F.col("vec").isNotNull()).select("vec", F.xxhash64(F.col("id"), F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    dim = max(len(r["vec"]) for r in rows)
    m = np.array([r["vec"] for r in rows if len(r["vec"]) == dim], dtype=np.float64)
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.argmax(m @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                v = m[near == c].mean(axis=0)
                n = np.linalg.norm(v)
                centres[c] = v / n if n > 0 else v
    return centres


def nearest_cells(vectors: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """``vectors`` with one row for each of the ``n`` cells nearest to it; vectors of another dimension are in cell -1."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centres)  # cells x dimension numbers, whatever the rows

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def cells(vec: pd.Series) -> pd.Series:
        c = shared.value
        fits = vec.map(lambda v: v is not None and len(v) == c.shape[1])
        out = pd.Series([[-1]] * len(vec), index=vec.index)
        if fits.any():
            s = np.stack(vec[fits].to_numpy()).astype(np.float64) @ c.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :n]
            out[fits] = pd.Series(list(best.astype(int).tolist()), index=vec.index[fits])
        return out

    return vectors.withColumn("cell", F.explode(cells("vec")))


def cell_topk(vectors: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """``query_id, id, score, rank``: the best of the ``probes`` cells nearest to each query. Large cells are split."""
    rows = vectors.filter(F.col("vec").isNotNull() & F.col("id").isNotNull()).select("id", "vec").dropDuplicates(["id"])
    qs = queries.filter(F.col("vec").isNotNull() & F.col("query_id").isNotNull()).select("query_id", "vec").dropDuplicates(["query_id"])
    placed = staged(nearest_cells(rows, centres, 1))
    asked = staged(nearest_cells(qs, centres, probes))
    parts = staged(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")))
    left = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("id", "vec", "cell", "part")
    right = asked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query_id", "vec", "cell", "part")
    schema = f"query_id {dict(qs.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"
    fn = partial(_multiply, k=k, least=float("-inf"))
    best = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(lambda v, q: fn(v, q), schema)
    return top_ranked(best, k, ["query_id"], "id")


def recall(approximate: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row ``recall``: the share of the exact ``k`` best that were found."""
    exact = dense_topk(vectors, queries, k).select("query_id", "id")
    found = exact.join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return found.agg(F.round(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)), 6).alias("recall"))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, cells: int | None = None, probes: int | None = None) -> DataFrame:
    """Exact search, or, where the caller names ``cells`` and ``probes``, that of the nearest ``probes`` of so many cells.

    The number of rows changes nothing; what a choice of cells and probes finds is measured by ``recall``.
    """
    if cells is None:
        return dense_topk(vectors, queries, k)
    return cell_topk(vectors, queries, fit_centres(vectors, cells), k, probes or cells)
