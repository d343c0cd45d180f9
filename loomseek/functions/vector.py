"""Vector expressions and the hash embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.functions.runs import HashTerms, counted

PROJECTIONS = 4


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def l2_normalise(v: Column) -> Column:
    """Unit length; a vector of (nearly) no length becomes the first unit vector."""
    n = norm(v)
    unit = F.transform(v, lambda x: x.cast("double") / n)
    first = F.transform(v, lambda _, i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(n < 1e-12, first).otherwise(unit)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero or the lengths differ."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0), inner_product(a, b) / (na * nb)).otherwise(F.lit(0.0))


def _places(term: str, dim: int) -> tuple[list[int], list[float]]:
    """Where a term goes and with which sign, by the digits of its MD5."""
    digits = hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()
    at = [int(digits[8 * j : 8 * j + 7], 16) % dim for j in range(PROJECTIONS)]
    return at, [1.0 if int(digits[8 * j + 7], 16) >= 8 else -1.0 for j in range(PROJECTIONS)]


def _embed(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    memory, placed = HashTerms(), 0
    places, signs = np.zeros((1024, PROJECTIONS), dtype=np.int64), np.zeros((1024, PROJECTIONS))
    for b in batches:
        if memory.trim():
            placed = 0
        numbers = [memory.of(t) for t in b.column(1).to_pylist()]
        while len(places) < len(memory.terms):
            places, signs = np.concatenate([places, places]), np.concatenate([signs, signs])
        for n in range(placed, len(memory.terms)):
            places[n], signs[n] = _places(memory.terms[n], dim)
        placed = len(memory.terms)
        r, t, tf = counted(numbers, len(memory.terms))
        weight = signs[t] * (1 + np.log(tf))[:, None]
        out = np.bincount((r[:, None] * dim + places[t]).ravel(), weights=weight.ravel(), minlength=len(numbers) * dim).reshape(-1, dim)
        # as l2_normalise has it, in the same order of summation
        length = np.sqrt(np.cumsum(out * out, axis=1)[:, -1])
        none = length < 1e-12
        out = np.where(none[:, None], np.eye(1, dim), out / np.where(none, 1.0, length)[:, None])
        offsets = pa.array(np.arange(len(numbers) + 1, dtype=np.int32) * dim)
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), type=pa.float64()))], names=[b.schema[0].name, "vec"])


def hash_embed(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``key, vec``: signed feature hashing of terms, PROJECTIONS places a term, weight ``1 + ln(tf)``, unit length.

    Places come from the digits of MD5, so other engines can repeat them. A text without terms is the first unit vector. A row is
    one text: nothing is shuffled, and a repeated row has its vector again.
    """
    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(partial(_embed, dim=dim), f"`{key}` {kind}, vec array<double>")


# Fixed value: the envelope of a query for encoders that are trained on instructions.
INSTRUCTION = "Instruct: {task}\nQuery:{query}"


def with_instruction(embed: Callable[[DataFrame, str, str], DataFrame], task: str) -> Callable[[DataFrame, str, str], DataFrame]:
    """``embed`` for queries: their texts in the envelope of a task. Contents are embedded without it."""
    head, tail = INSTRUCTION.format(task=task, query="\x00").split("\x00")

    def wrapped(rows: DataFrame, key: str, text: str) -> DataFrame:
        return embed(rows.withColumn(text, F.concat(F.lit(head), F.col(text), F.lit(tail))), key, text)

    return wrapped
