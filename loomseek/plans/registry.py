"""The registry of index versions: publish, list, use, remove, collect garbage.

A version is published by its row in the manifests, written after everything it refers to. Rows are only ever
appended; the newest event of a version counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseek import errors
from loomseek.errors import NotFound
from loomseek.operators.families import unreferenced_blobs

SCHEMA = "version_id string, parent_version string, event string, chunk_count bigint, model_id string, seq bigint, at timestamp"


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _events(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:  # before the first event
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _append(self, version_id: str, event: str, parent: str | None = None, chunk_count: int | None = None, model_id: str | None = None) -> None:
        row = self.spark.createDataFrame([(version_id, parent, event, chunk_count, model_id)], "version_id string, parent_version string, event string, chunk_count bigint, model_id string")
        # the number orders events that fall into one tick of the clock; there is one writer at a time
        seq = self._events().agg(F.max("seq")).first()[0]
        row.withColumn("seq", F.lit((seq or 0) + 1).cast("bigint")).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    def publish(self, version_id: str, chunks: DataFrame, parent: str | None = None, model_id: str | None = None) -> None:
        """Makes a version visible; its chunks must be written already."""
        if parent == version_id:
            raise ValueError("a version is not its own parent")
        self._append(version_id, "published", parent, chunks.count(), model_id)

    def versions(self) -> DataFrame:
        """Published versions that were not removed, newest first: ``version_id, parent_version, chunk_count, model_id, at, active``."""
        e = self._events()
        last = Window.partitionBy("version_id").orderBy(F.desc("seq"))
        live = e.filter("event <> 'used'").withColumn("_n", F.row_number().over(last)).filter("_n = 1 AND event = 'published'").drop("_n", "event")
        chosen = self.active()
        return live.withColumn("active", F.col("version_id") == F.lit(chosen) if chosen else F.lit(False)).orderBy(F.desc("seq"), "version_id")

    def active(self) -> str | None:
        """The version in use: the last one chosen that is still there, else the newest."""
        e = self._events()
        removed = Window.partitionBy("version_id").orderBy(F.desc("seq"))
        live = e.filter("event <> 'used'").withColumn("_n", F.row_number().over(removed)).filter("_n = 1 AND event = 'published'").select("version_id", F.col("seq").alias("since"))
        used = e.filter("event = 'used'").join(live, "version_id").orderBy(F.desc("seq")).select("version_id").first()
        newest = used or live.orderBy(F.desc("since"), "version_id").select("version_id").first()
        return newest["version_id"] if newest else None

    def resolve(self, version_id: str | None = None) -> str:
        """The version asked for, else the active one; an unknown one is an error."""
        found = version_id or self.active()
        if found is None or self.versions().filter(F.col("version_id") == found).isEmpty():
            raise NotFound(errors.VERSION_NOT_FOUND, f"no such version: {found}")
        return found

    def use(self, version_id: str) -> None:
        self.resolve(version_id)
        self._append(version_id, "used")

    def remove(self, version_id: str) -> None:
        self.resolve(version_id)
        self._append(version_id, "removed")

    def garbage(self, blobs: DataFrame, chunks: DataFrame) -> DataFrame:
        """Vectors that no version still there refers to."""
        return unreferenced_blobs(blobs, chunks.join(self.versions().select("version_id"), "version_id", "left_semi"))
