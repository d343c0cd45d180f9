"""Vector search: exact top-k by blocks of queries, without moving the vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomseek.operators.ranks import top_ranked

#: Bytes of the queries of one block, which every worker gets, and of the results a worker holds for them.
BLOCK_BYTES = 64 << 20
#: Rows of vectors and of queries that are multiplied at once.
ROWS, COLUMNS = 4096, 512


def _multiply(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    out = []
    if not len(vectors) or not len(queries):
        return pd.DataFrame({"query_id": queries["query_id"][:0], "id": vectors["id"][:0], "score": np.zeros(0)})
    for dim, qs in queries.groupby(queries["vec"].map(len)):
        # vectors of another dimension cannot be compared
        part = vectors[vectors["vec"].map(len) == dim]
        if not len(part):
            continue
        ids = part["id"].to_numpy()
        scores = np.stack(part["vec"].to_numpy()).astype(np.float64) @ np.stack(qs["vec"].to_numpy()).astype(np.float64).T
        for j, q in enumerate(qs["query_id"]):
            s = scores[:, j]
            keep = np.flatnonzero(s >= least)
            if len(keep) > k:
                # all that tie with the k-th stay, the final ranking decides
                cut = np.partition(np.round(s[keep], 9), len(keep) - k)[len(keep) - k]
                keep = keep[np.round(s[keep], 9) >= cut]
            out.append(pd.DataFrame({"query_id": q, "id": ids[keep], "score": s[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": queries["query_id"][:0], "id": vectors["id"][:0], "score": np.zeros(0)})


class Best:
    """The ``k`` best rows of each query so far, in the order of falling score and rising id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.s, self.ids, self.held = [], [], [], 0

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        self.q.append(q)
        self.s.append(s)
        self.ids.append(ids)
        self.held += len(q)
        if self.held > max(500_000, 2 * self.k * len(self.least)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.q:
            return np.zeros(0, int), np.zeros(0), np.zeros(0, object)
        q, s, ids = (np.concatenate(x) for x in (self.q, self.s, self.ids))
        order = np.lexsort((-s, q))
        q, s, ids = q[order], s[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        count = np.diff(np.append(first, len(q)))
        full = count >= self.k
        self.least[q[first[full]]] = s[first[full] + self.k - 1]
        keep = s >= self.least[q]
        for f, n in zip(first[full], count[full]):
            # of those that tie with the last the least ids stay
            ties = f + np.flatnonzero(s[f : f + n] == s[f + self.k - 1])
            room = f + self.k - ties[0]
            if len(ties) > room:
                keep[ties] = False
                keep[ties[np.argsort(ids[ties], kind="stable")[:room]]] = True
        self.q, self.s, self.ids = [q[keep]], [s[keep]], [ids[keep]]
        self.held = int(keep.sum())
        return self.q[0], self.s[0], self.ids[0]


def _matrix(vecs: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of dimension ``dim``, and their vectors; vectors of another dimension cannot be compared."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vecs), dim), False).to_numpy(zero_copy_only=False))
    values = vecs.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return fits, values.reshape(len(fits), dim)


def _local(batches: Iterator[pa.RecordBatch], shared, k: int | None, least: float, id_type: pa.DataType, query_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    names, matrix = shared.value
    best = Best(len(names), k) if k is not None else None

    def batch(q: np.ndarray, ids, s: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(names[q].tolist(), type=query_type), pa.array(list(ids), type=id_type), pa.array(s, type=pa.float64())], names=["query_id", "id", "score"])

    for b in batches:
        rows, every = _matrix(b.column(1), matrix.shape[1])
        for a in range(0, len(rows), ROWS):
            v, these = every[a : a + ROWS], rows[a : a + ROWS]
            for c in range(0, len(names), COLUMNS):
                scores = v @ matrix[c : c + COLUMNS].T
                rounded = np.round(scores, 9)
                if best is None:
                    at, q = np.nonzero(scores >= least)
                    if len(at):
                        yield batch(q + c, b.column(0).take(pa.array(these[at])).to_pylist(), scores[at, q])
                    continue
                bar = best.least[c : c + COLUMNS]
                if len(v) > k:
                    bar = np.maximum(bar, np.partition(rounded, len(v) - k, axis=0)[len(v) - k])
                at, q = np.nonzero((rounded >= bar) & (scores >= least))
                ids = np.empty(len(at), dtype=object)
                ids[:] = b.column(0).take(pa.array(these[at])).to_pylist()
                best.add(q + c, rounded[at, q], ids)
    if best is not None:
        q, s, ids = best.cut()
        for a in range(0, len(q), 100_000):
            yield batch(q[a : a + 100_000], ids[a : a + 100_000], s[a : a + 100_000])


def dense_scores(vectors: DataFrame, queries: DataFrame, k: int | None, least: float = float("-inf")) -> DataFrame:
    """Candidates ``query_id, id, score``: of each partition of the vectors the ``k`` best of each query; all from ``least`` on if ``k`` is None.

    A stated query set (query_id, vec) against all rows (id, vec), in blocks of bounded bytes: each worker gets a block and passes over
    its vectors, which are not moved; what leaves a partition is ``k`` rows a query. Null ids and vectors are left out, repeated ids count once.
    """
    rows = vectors.filter(F.col("vec").isNotNull() & F.col("id").isNotNull()).select("id", "vec")
    qs = queries.filter(F.col("vec").isNotNull() & F.col("query_id").isNotNull()).select("query_id", "vec").dropDuplicates(["query_id"])
    schema = f"query_id {dict(qs.dtypes)['query_id']}, id {dict(rows.dtypes)['id']}, score double"
    arrow = {f.name: to_arrow_type(f.dataType) for f in (rows.schema["id"], qs.schema["query_id"])}
    sizes = qs.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a dimension
    out = [rows.sparkSession.createDataFrame([], schema)]
    for r in sorted(sizes):
        blocks = -(-r["n"] * max(8 * r["dim"], 16 * (k or 1)) // BLOCK_BYTES)
        for b in range(blocks):
            block = qs.filter((F.size("vec") == r["dim"]) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
            if block:
                names = np.empty(len(block), dtype=object)
                names[:] = [x["query_id"] for x in block]
                shared = rows.sparkSession.sparkContext.broadcast((names, np.array([x["vec"] for x in block], dtype=np.float64).reshape(len(block), r["dim"])))
                out.append(rows.mapInArrow(partial(_local, shared=shared, k=k, least=least, id_type=arrow["id"], query_type=arrow["query_id"]), schema))
    found = reduce(DataFrame.unionByName, out[1:] or out)
    return found.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, least: float = float("-inf")) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` largest inner products of each query with all vectors."""
    return top_ranked(dense_scores(vectors, queries, k, least), k, ["query_id"], "id")


def pairs_above(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """``query_id, id, score`` of all pairs with at least this inner product, but a vector with itself.

    The result is as large as the pairs are many: choose ``least`` so that they are few.
    """
    return dense_scores(vectors, queries, None, least).filter(F.col("query_id") != F.col("id")).withColumn("score", F.round("score", 9))
