"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

PART_BYTES = 16 << 20
#: Tables of so few rows are worked on in FEW_TASKS tasks.
FEW, FEW_TASKS = 200_000, 6
#: Used only where the session names no checkpoint folder and all runs in one process, as in tests.
LOCAL_FALLBACK = "file:///tmp/checkpoints"


def checkpoint_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; without one a local session gets a folder of our own, and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_FALLBACK
    raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")


def tasks_for(source: DataFrame) -> int:
    """A task for each PART_BYTES that the planner expects of a source, and two a core at least."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1_000_000, max(2 * source.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


class Scratch:
    """Writes DataFrames as Parquet under the shared checkpoint folder and reads them back.

    A saved table has no lineage, so a lost executor costs the tasks in flight and nothing before them. drop() frees
    tables that are no longer read; what a caller's lazy result still reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str, source: DataFrame | None = None):
        """source: what the tables are derived from. A table gets a file for each PART_BYTES of it, so that a small source doesn't end in many small files."""
        self.spark = spark
        self.most = None if source is None else tasks_for(source)
        self.root = f"{checkpoint_root(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str, rows: int | None = None, whole: bool = False) -> DataFrame:
        """rows: about how many it can have, if known; FEW of them make FEW_TASKS files at most. whole: partitions stay as they are."""
        path = f"{self.root}/{name}"
        if not whole:
            df = df.coalesce(FEW_TASKS) if rows is not None and rows <= FEW else self.bounded(df)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bounded(self, df: DataFrame) -> DataFrame:
        """df in no more tasks than its source is worth."""
        return df if self.most is None else df.coalesce(self.most)

    def counted(self, df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, int]:
        """The saved table and how many rows it has."""
        saved = self.save(df, name, rows)
        return saved, saved.count()

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None or context._gateway is None:
            return
        try:
            jpath = context._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(context._jsc.hadoopConfiguration()).delete(jpath, True)
        except Exception:  # the JVM may have ended before the driver's exit hook
            return
