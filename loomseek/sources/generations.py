"""Folders that become visible as a whole: generations, and the commits that name them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Generations:
    """A folder of generations ``g-...``. One is in force once ``commits/<number>`` names it.

    That file is put in place by a rename that fails if the number is taken: of two writers at the same time one fails and has
    published nothing. The rename is atomic on HDFS and POSIX file systems; on an object store it is as atomic as the store's
    connector makes it. A writer that dies before leaves the last generation in force, and its folder is removed by ``vacuum``,
    which the next writer calls: there must be one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        """Hadoop's view of the file system, so the folder may lie wherever Spark can write."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        hadoop, fs = self._files()
        path = hadoop.Path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def commits(self) -> list[str]:
        """The published generations, oldest first."""
        names = [n for n in self._names(f"{self.path}/commits") if n.isdigit()]
        if not names:
            return []
        found = self.spark.read.text([f"{self.path}/commits/{n}" for n in names]).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("n"), "value")
        return [r["value"] for r in sorted(found.collect(), key=lambda r: r["n"])]

    def generation(self) -> str | None:
        """The last published generation, or None before the first."""
        got = self.commits()
        return got[-1] if got else None

    def new(self) -> str:
        return f"g-{uuid.uuid4().hex}"

    def at(self, generation: str, part: str) -> str:
        return f"{self.path}/{generation}/{part}"

    def publish(self, generation: str, number: int) -> None:
        hadoop, fs = self._files()
        draft, commit = hadoop.Path(self.at(generation, "commit")), hadoop.Path(f"{self.path}/commits/{number:012d}")
        fs.mkdirs(commit.getParent())
        out = fs.create(draft, True)
        out.writeBytes(generation)
        out.close()
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        hadoop.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(draft), fs.makeQualified(commit), how)

    def vacuum(self) -> None:
        """Removes the folders of writers that died."""
        hadoop, fs = self._files()
        alive = set(self.commits())
        for name in self._names(self.path):
            if name.startswith("g-") and name not in alive:
                fs.delete(hadoop.Path(f"{self.path}/{name}"), True)
