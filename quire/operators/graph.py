"""Connected components inside packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoints(spark) -> None:
    """Sets a checkpoint folder where there is none: the session's, else one of our own if all runs in one process; on a cluster that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir(named or "file:///tmp/checkpoints")


def components(edges: DataFrame) -> DataFrame:
    """(package_id, id, component): the smallest id that each end of (package_id, a, b) reaches within its package.

    Large-star and small-star rounds on aggregates and joins; every round is checkpointed in the session's checkpoint folder, so
    neither the plan nor the lineage grows and a lost executor costs one round. Rounds go on until one changes nothing; their number
    grows with the logarithm of the longest path, and no graph is left unfinished.
    """
    ensure_checkpoints(edges.sparkSession)
    k = "package_id"
    now = edges.select(k, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    before = None
    while True:
        both = now.unionByName(now.select(k, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(k, "a").agg(F.min("b").alias("m")).select(k, "a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, [k, "a"]).select(k, F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        low = large.groupBy(k, "a").agg(F.min("b").alias("m"))
        moved = large.join(low, [k, "a"]).filter("b <> m").select(k, F.col("b").alias("a"), F.col("m").alias("b"))
        after = moved.unionByName(low.select(k, "a", F.col("m").alias("b"))).distinct().checkpoint()
        state = after.agg(F.count("*"), F.sum(F.xxhash64(k, "a", "b").cast("decimal(38,0)"))).first()
        now = after
        if state == before:
            break
        before = state
    leaves = now.select(k, F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(now.select(k, F.col("b").alias("id"), F.col("b").alias("component")).distinct())
