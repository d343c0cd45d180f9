"""Structured Streaming extensions: incremental vectors, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.functions.vector import hash_embed
from loomseek.sources.files import CHUNK_SCHEMA, add_blobs


def embed_new_chunks(spark: SparkSession, chunks_path: str, blobs_path: str, checkpoint: str, model_id: str = "hash-64"):
    """Embeds the chunks that arrived since the last run and ends. Contents that have a vector cost nothing."""

    def batch(df: DataFrame, _: int) -> None:
        rows = df.select("content_hash", "text").dropDuplicates(["content_hash"])
        vecs = hash_embed(rows, "content_hash", "text")
        add_blobs(blobs_path, vecs.select("content_hash", F.lit(model_id).alias("model_id"), F.size("vec").alias("dim"), "vec"))

    stream = spark.readStream.schema(CHUNK_SCHEMA).parquet(chunks_path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their summed value per window and type; rows later than ``late`` behind the newest are dropped from streams."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    agg = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per user and session; a session ends after ``gap`` without an event."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    agg = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("session_start"), "n")
