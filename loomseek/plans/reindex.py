"""Incremental reindexing: only changed files are chunked, only new contents are embedded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.functions.text import content_hash
from loomseek.functions.vector import hash_embed
from loomseek.operators.chunking import chunk_files
from loomseek.operators.families import carried_over, diff_by_hash, embedding_misses, paths_to_process
from loomseek.session import staged


@dataclass
class Reindexed:
    """The new version: its chunks, the vectors it adds, and what was done."""

    chunks: DataFrame
    new_blobs: DataFrame
    report: dict[str, int]


def file_hashes(files: DataFrame) -> DataFrame:
    """``path, hash`` of ``file_path, content``; line ends and blank runs do not count."""
    return files.filter(F.col("content").isNotNull()).groupBy(F.col("file_path").alias("path")).agg(content_hash(F.max("content")).alias("hash"))


def reindex(parent_chunks: DataFrame, parent_hashes: DataFrame, files: DataFrame, blobs: DataFrame, version_id: str, model_id: str = "hash-64") -> Reindexed:
    """A version from its parent and the new ``repo, file_path, content``, with one repository at a time.

    Chunks of unchanged files are carried over; changed and added files are chunked; contents without a vector
    of the model are embedded. An empty parent gives a full index. A rename costs chunking but no vectors.
    """
    diff = diff_by_hash(parent_hashes, file_hashes(files))
    status = F.when(F.col("status") == "added", "A").when(F.col("status") == "deleted", "D").otherwise("M")
    actions = staged(paths_to_process(diff.select("path", status.alias("status"), F.lit(None).cast("string").alias("old_path"))))
    carried = carried_over(parent_chunks, actions, version_id)
    todo = files.join(actions.filter("action = 'chunk'").select(F.col("path").alias("file_path")), "file_path", "left_semi")
    fresh = staged(chunk_files(todo).withColumn("version_id", F.lit(version_id)))
    chunks = staged(carried.select(*[c for c in fresh.columns if c in carried.columns]).unionByName(fresh, allowMissingColumns=True))
    misses = staged(embedding_misses(chunks, blobs, model_id))
    texts = chunks.join(misses, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("text").alias("text"))
    vecs = hash_embed(texts, "content_hash", "text")
    new = staged(vecs.select("content_hash", F.lit(model_id).alias("model_id"), F.size("vec").alias("dim"), "vec"))
    n, built = chunks.count(), fresh.count()
    contents = chunks.select("content_hash").distinct().count()
    embedded = new.count()
    return Reindexed(chunks, new, {"chunk_count": n, "chunks_carried": n - built, "chunks_rebuilt": built, "embed_calls": embedded, "blobs_reused": contents - embedded})
