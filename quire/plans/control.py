"""Stopping runs: jobs carry a tag, and who holds the tag can stop them from any thread."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """What runs inside can be stopped by cancel(); it then fails with Spark's error of a cancelled job."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stops the jobs under a tag; what they had begun to write is left to the committer, whole folders to sinks.put_aside()."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession) -> list[tuple[int, int, int, int]]:
    """(stage, tasks, done, running) of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    known = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return [(s.stageId, s.numTasks, s.numCompletedTasks, s.numActiveTasks) for s in known if s is not None]
