"""Snippet families across versions, and the versions of the index themselves."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.functions.text import family_id
from loomseek.settings import DEFAULT


def _group(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Greedy complete linkage of one key's snippets, newest first: a member joins the first group it is close to as a whole."""
    pdf = pdf.sort_values(["version_order", "start_line", "chunk_id"]).reset_index(drop=True)
    unit: list[np.ndarray | None] = []
    for v in pdf["vec"]:
        a = None if v is None else np.asarray(v, dtype=float)
        n = 0.0 if a is None else float(np.linalg.norm(a))
        unit.append(None if a is None else a / n if n > 0 else np.zeros_like(a))
    groups: list[list[int]] = []
    versions = pdf["version_id"].tolist()
    taken: list[set] = []  # the versions of each group
    sides: list[np.ndarray] = []  # the vectors of each group, one below the other
    for i in range(len(pdf)):
        home = None
        if unit[i] is not None:
            for n, side in enumerate(sides):
                if side is not None and versions[i] not in taken[n] and side.shape[1] == len(unit[i]) and (np.round(side @ unit[i], 12) >= least).all():
                    home = n
                    break
        if home is None:
            groups.append([i])
            taken.append({versions[i]})
            sides.append(None if unit[i] is None else unit[i][None])
        else:
            groups[home].append(i)
            taken[home].add(versions[i])
            sides[home] = np.vstack([sides[home], unit[i]])
    number = np.empty(len(pdf), dtype=np.int64)
    place = np.empty(len(pdf), dtype=np.int64)
    for n, g in enumerate(groups):
        for m, i in enumerate(g):
            number[i], place[i] = n, m
    return pdf[["symbol", "file_path", "version_id", "chunk_id"]].assign(family_no=number, member_no=place)


def build_families(snippets: DataFrame, least: float = DEFAULT.dedupe_cosine) -> DataFrame:
    """``symbol, file_path, version_id, chunk_id, family_no, member_no`` from ``..., start_line, version_order, vec``.

    Snippets of one symbol (null is a symbol of its own) and path group if every pair has at least this cosine, one per
    version, newest (least ``version_order``) first. Without a vector a snippet is a family of its own. The grouping
    depends on the order, so a key is handled by one task; a key has a snippet per version and definition.
    """
    rows = snippets.select("symbol", "file_path", "version_id", "chunk_id", "start_line", "version_order", "vec").dropDuplicates(["symbol", "file_path", "version_id", "chunk_id"])
    schema = "symbol string, file_path string, version_id string, chunk_id string, family_no bigint, member_no bigint"
    return rows.groupBy("symbol", "file_path").applyInPandas(lambda pdf: _group(pdf, least), schema)


def identity_families(snippets: DataFrame) -> DataFrame:
    """Without vectors every snippet is a family of its own: the columns of ``build_families``."""
    rows = snippets.select("symbol", "file_path", "version_id", "chunk_id").distinct()
    number = F.row_number().over(Window.partitionBy("symbol", "file_path").orderBy("version_id", "chunk_id")) - 1
    return rows.withColumn("family_no", number.cast("bigint")).withColumn("member_no", F.lit(0).cast("bigint"))


def family_table(members: DataFrame, total_versions: int) -> DataFrame:
    """One row per family: id, representative, members and versions newest first, stability."""
    keyed = members.withColumn("family_id", family_id(F.col("symbol"), F.col("file_path")))
    f = keyed.groupBy("family_id", "symbol", "file_path", "family_no").agg(F.sort_array(F.collect_list(F.struct("member_no", "chunk_id", "version_id"))).alias("m"))
    n = F.size("m")
    return f.select(
        "family_id",
        "family_no",
        "symbol",
        "file_path",
        F.element_at("m", 1)["chunk_id"].alias("representative"),
        F.transform("m", lambda x: x["chunk_id"]).alias("members"),
        F.transform("m", lambda x: x["version_id"]).alias("versions"),
        F.round(n / F.greatest(F.lit(total_versions), n, F.lit(1)), 9).alias("stability"),
    )


def stability_bonus(base: Column, versions: Column, stability: Column, bonus: float = DEFAULT.stability_bonus) -> Column:
    """``base * (1 + bonus * stability)`` for families of two versions or more, clamped to [0, 1]."""
    boosted = F.when(F.size(versions) >= 2, base * (1 + F.lit(bonus) * stability)).otherwise(base)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), boosted))


def collapse(results: DataFrame, by: str = "family_id", key: str = "chunk_id") -> DataFrame:
    """The best result of each family and query, with the ids of all its results in order."""
    w = Window.partitionBy("query_id", by).orderBy(F.desc("score"), key)
    listed = results.withColumn("_n", F.row_number().over(w))
    return listed.groupBy("query_id", by).agg(F.max("score").alias("score"), F.min_by(key, "_n").alias(key), F.transform(F.sort_array(F.collect_list(F.struct("_n", key))), lambda x: x[key]).alias("members"))


@F.pandas_udf(T.StringType())
def unified_diff(older: pd.Series, newer: pd.Series) -> pd.Series:
    """The change from the older to the newer text, with three lines of context."""
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), "older", "newer", n=3)) for a, b in zip(older, newer)])


def consecutive_diffs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The diff of each member against the next older one of its family."""
    w = Window.partitionBy("symbol", "file_path", "family_no").orderBy("member_no")
    rows = members.join(texts.select("chunk_id", "version_id", "text").dropDuplicates(["chunk_id", "version_id"]), ["chunk_id", "version_id"])
    pairs = rows.withColumn("older", F.lead("text").over(w)).filter(F.col("older").isNotNull())
    return pairs.select("symbol", "file_path", "family_no", "member_no", unified_diff("older", "text").alias("diff"))


def diff_by_hash(parent: DataFrame, current: DataFrame) -> DataFrame:
    """``path, status`` of two tables ``path, hash``: added, modified or deleted."""
    p, c = parent.select("path", F.col("hash").alias("h0")).distinct(), current.select("path", F.col("hash").alias("h1")).distinct()
    both = p.withColumn("in0", F.lit(True)).join(c.withColumn("in1", F.lit(True)), "path", "full_outer")
    status = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "deleted").when(~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return both.select("path", status.alias("status")).filter(F.col("status").isNotNull())


def paths_to_process(diff: DataFrame) -> DataFrame:
    """``path, action`` of a diff with renames and copies: what to drop and what to chunk.

    diff: ``path, status, old_path`` with A, M, D, R, C and T. A rename drops its source and chunks its
    destination, a copy is an addition.
    """
    actions = (
        F.when(F.col("status") == "D", F.array(F.struct(F.col("path").alias("path"), F.lit("drop").alias("action"))))
        .when(F.col("status") == "R", F.array(F.struct(F.col("old_path").alias("path"), F.lit("drop").alias("action")), F.struct(F.col("path").alias("path"), F.lit("chunk").alias("action"))))
        .when(F.col("status").isin("A", "C"), F.array(F.struct(F.col("path").alias("path"), F.lit("chunk").alias("action"))))
        .otherwise(F.array(F.struct(F.col("path").alias("path"), F.lit("drop").alias("action")), F.struct(F.col("path").alias("path"), F.lit("chunk").alias("action"))))
    )
    return diff.select(F.explode(actions).alias("a")).select("a.*").distinct()


def carried_over(parent_chunks: DataFrame, actions: DataFrame, version_id: str) -> DataFrame:
    """Chunks of the parent version whose file is neither dropped nor chunked again, stamped with the new version."""
    return parent_chunks.join(actions.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").withColumn("version_id", F.lit(version_id))


def embedding_misses(chunks: DataFrame, blobs: DataFrame, model_id: str) -> DataFrame:
    """Distinct content hashes that have no vector of the model yet."""
    have = blobs.filter(F.col("model_id") == model_id).select("content_hash")
    return chunks.filter(F.col("content_hash").isNotNull()).select("content_hash").distinct().join(have, "content_hash", "left_anti")


def unreferenced_blobs(blobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose content no version refers to."""
    return blobs.join(chunks.select("content_hash").distinct(), "content_hash", "left_anti")


def newest_first(versions: DataFrame) -> DataFrame:
    """``repo, version_id, age``: 0 for the newest run of a repository; ties by version id."""
    w = Window.partitionBy("repo").orderBy(F.desc("started_at"), "version_id")
    return versions.select("repo", "version_id", "started_at").distinct().withColumn("age", F.row_number().over(w) - 1).select("repo", "version_id", "age")


def active_versions(reports: DataFrame) -> DataFrame:
    """The version a query without one is answered from: each repository's newest that was published."""
    return newest_first(reports.filter(F.col("manifest_path").isNotNull())).filter("age = 0").select("repo", "version_id")
