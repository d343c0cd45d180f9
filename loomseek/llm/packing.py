"""Problem 8: filling fixed-capacity containers with items.

Method: optimal length buckets. A dynamic program over the global histogram of sizes (at most
``capacity`` bins, whatever the data's size) chooses bucket boundaries that minimise the padding of
items to their bucket's boundary; batches under the token budget are then formed from buckets.

Batches of one bucket alone waste much of a container (an item just above half the capacity shares
it with nobody), so a batch may take from several buckets: largest bucket first, then the largest
that still fits. Batches are planned for buckets with their counts, so the plan's size depends on the
capacity only. ``within_buckets`` gives the plan with one bucket per batch for comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 4096
BUCKETS = 512
#: Rows that one numbering window handles.
SALT_ROWS = 100_000


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``cost(i, j)``, the padding of sizes ``i+1..j`` to ``sizes[j]``, is ``sizes[j] * (N_j - N_i) - (S_j - S_i)``
    with prefix sums N of counts and S of tokens: each round of the program takes lower envelopes of
    lines with falling slopes, queried at rising points.
    """
    n = len(sizes)
    if n <= buckets:
        return sizes.copy()
    big_n = np.concatenate([[0], np.cumsum(counts)]).astype(float).tolist()
    big_s = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(float).tolist()
    u = [0.0, *sizes.astype(float).tolist()]
    best = [0.0] + [float("inf")] * n
    back = []
    for _ in range(buckets):
        hull: list[int] = []
        nxt, arg, at = [float("inf")] * (n + 1), [0] * (n + 1), 0
        line = lambda i: (-big_n[i], best[i] + big_s[i])
        for j in range(1, n + 1):
            if best[j - 1] < float("inf"):
                m, b = line(j - 1)
                while len(hull) - at >= 2:
                    m1, b1 = line(hull[-1])
                    m2, b2 = line(hull[-2])
                    if (b - b2) * (m2 - m1) > (b1 - b2) * (m2 - m):
                        break
                    hull.pop()
                hull.append(j - 1)
            while len(hull) - at >= 2 and line(hull[at + 1])[0] * u[j] + line(hull[at + 1])[1] <= line(hull[at])[0] * u[j] + line(hull[at])[1]:
                at += 1
            if len(hull) > at:
                m, b = line(hull[at])
                nxt[j], arg[j] = u[j] * big_n[j] - big_s[j] + m * u[j] + b, hull[at]
        back.append(arg)
        best = nxt
    bounds, j = [], n
    for arg in reversed(back):
        bounds.append(int(u[j]))
        j = arg[j]
        if j == 0:
            break
    return np.array(bounds[::-1])


def plan_batches(bounds: np.ndarray, counts: np.ndarray, capacity: int, mix: bool = True) -> list[tuple[int, dict[int, int]]]:
    """Batches as ``(how many, {bucket: items in each})``; all counts are used up.

    A batch opens with the largest bucket left and takes from the largest buckets that still fit.
    Equal batches are planned at once, so each step empties a bucket or leaves less than a batch of it.
    """
    left, out = counts.astype(np.int64).copy(), []
    for k in range(len(bounds) - 1, -1, -1):
        while left[k]:
            room, batch, i = capacity, {}, k
            while i >= 0 and room > 0:
                if left[i] and bounds[i] <= room:
                    take = int(min(left[i], room // bounds[i]))
                    batch[i] = take
                    room -= take * int(bounds[i])
                if not mix:
                    break
                i = min(i - 1, int(np.searchsorted(bounds, room, side="right")) - 1)
            times = int(min(left[i] // m for i, m in batch.items()))
            out.append((times, batch))
            for i, m in batch.items():
                left[i] -= times * m
    return out


def items(documents: DataFrame, id_column: str, size: Column, capacity: int) -> DataFrame:
    """``id, piece, start, end``: every item, and the pieces of those beyond the capacity."""
    whole = documents.select(F.col(id_column).alias("id"), size.cast("bigint").alias("size")).groupBy("id").agg(F.max("size").alias("size")).filter((F.col("size") > 0) & F.col("id").isNotNull())
    last = F.floor((F.col("size") - 1) / capacity).cast("int")
    return whole.select("id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.col("size"), (F.col("piece").cast("bigint") + 1) * capacity).alias("end")
    )


def _place(batches: Iterator[pd.DataFrame], bounds: np.ndarray, keys: np.ndarray, per_batch: np.ndarray, base: np.ndarray, stride: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        key = pdf["bucket"].to_numpy(np.int64) * stride + pdf["number"].to_numpy(np.int64)
        i = np.searchsorted(keys, key, side="right") - 1
        pdf["container"] = base[i] + (key - keys[i]) // per_batch[i]
        yield pdf[["id", "piece", "start", "end", "tokens", "bucket", "container"]]


def histogram(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and counts; at most ``capacity`` of them."""
    rows = parts.groupBy((F.col("end") - F.col("start")).alias("tokens")).count().collect()
    rows = sorted((r["tokens"], r["count"]) for r in rows)
    return np.array([t for t, _ in rows], dtype=np.int64), np.array([c for _, c in rows], dtype=np.int64)


def pack(documents: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, buckets: int = BUCKETS, mix: bool = True) -> DataFrame:
    """Every text's place: ``id, piece, start, end, tokens, bucket, container``.

    Tokens are UTF-8 bytes. A text beyond the capacity is cut every ``capacity`` tokens; its full pieces
    fill containers of their own. No other text is split. Rows that share an id count once, with the
    longest text; null ids, null and empty texts need no space and get no row.
    """
    parts = items(documents, id_column, F.octet_length(text), capacity)
    sizes, counts = histogram(parts)
    if not len(sizes):
        return parts.select("id", "piece", "start", "end", F.lit(0).cast("bigint").alias("tokens"), F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("container")).filter(F.lit(False))
    bounds = bucket_bounds(sizes, counts, buckets)
    of_size = np.searchsorted(bounds, sizes)
    per_bucket = np.bincount(of_size, weights=counts, minlength=len(bounds)).astype(np.int64)
    plan = plan_batches(bounds, per_bucket, capacity, mix)
    stride = int(per_bucket.max()) + 1
    used, base, slots = np.zeros(len(bounds), dtype=np.int64), 0, []
    for times, batch in plan:
        for k, m in batch.items():
            slots.append((k * stride + int(used[k]), m, base))
            used[k] += times * m
        base += times
    slots.sort()
    keys, per_batch, bases = (np.array(c, dtype=np.int64) for c in zip(*slots))
    tokens = (F.col("end") - F.col("start")).cast("bigint")
    bucket = F.element_at(F.lit([int(b) for b in np.searchsorted(bounds, np.arange(capacity + 1))]), (tokens + 1).cast("int"))
    salts = int(counts.sum()) // SALT_ROWS + 1
    rows = parts.withColumn("tokens", tokens).withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    by_salt = Window.partitionBy("bucket", "salt").orderBy("id", "piece")
    # numbers within a bucket: the rank inside a salt plus the rows of the salts before it
    before = (
        rows.groupBy("bucket", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    numbered = rows.withColumn("rank", F.row_number().over(by_salt)).join(before, ["bucket", "salt"]).withColumn("number", F.col("before") + F.col("rank") - 1)
    id_type = dict(parts.dtypes)["id"]
    place = partial(_place, bounds=bounds, keys=keys, per_batch=per_batch, base=bases, stride=stride)
    return numbered.select("id", "piece", "start", "end", "tokens", "bucket", "number").mapInPandas(place, f"id {id_type}, piece int, start bigint, end bigint, tokens bigint, bucket int, container bigint")


def split_items(packed: DataFrame) -> DataFrame:
    """``id`` of the items that were split: those with a second piece."""
    return packed.filter(F.col("piece") == 1).select("id").distinct()


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers, used, unused_share, over`` (containers beyond the capacity: 0)."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("used"),
        F.coalesce(1 - F.sum("used") / (F.count(F.lit(1)) * capacity), F.lit(0.0)).alias("unused_share"),
        F.count_if(F.col("used") > capacity).alias("over"),
    )
