"""Session helpers: reading tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a temporary folder is made and set once per
    session, but only in a local session: on a cluster a folder of one machine would lose rows, so it is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomseek-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_STAGED: list[str] = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    """Best effort: the JVM may be gone already."""
    try:
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the staged tables from number ``since`` on. DataFrames that read them are void afterwards."""
    gone = _STAGED[since:]
    del _STAGED[since:]
    _remove(spark, gone)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block go with its end; results must be written or collected within."""
    since = len(_STAGED)
    try:
        yield
    finally:
        release(spark, since)


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again.

    Unlike a cache it survives the loss of executors, and it cuts the lineage. The files go with the enclosing
    ``scratch``, with ``release``, or when the interpreter ends; a reader may need them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(release, spark)
    _STAGED.append(path)
    return written(df, path, *partition_by)


#: Spark's switch by which a query's shuffle files go with its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """``df`` written to ``path`` and read again; what it shuffled goes at once."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
