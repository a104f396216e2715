"""Exact duplicates and what is included where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_exact_duplicates(occ: DataFrame) -> DataFrame:
    """Adds is_duplicate, duplicate_of: all but the first occurrence of a hash in a package; ignored and unhashed rows stand apart.

    The first of each hash is an aggregate that joins back, so a hash that many rows share is no task of its own.
    """
    real = occ.filter("original_sha256 is not null and not is_ignored_artifact")
    first = real.groupBy("package_id", "original_sha256").agg(F.min_by("document_id", "traversal_index").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    dup = ~F.col("is_ignored_artifact") & F.col("_first").isNotNull() & (F.col("_first") != F.col("document_id"))
    joined = occ.join(first, ["package_id", "original_sha256"], "left").select(*[occ[c] for c in occ.columns], "_first")
    return joined.withColumn("is_duplicate", F.coalesce(dup, F.lit(False))).withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("_first"))).drop("_first")


def included_in_original() -> Column:
    return ~F.col("is_ignored_artifact")


def included_in_final() -> Column:
    """What stays in Final; a confident duplicate stays if it needs review or was restored (a null decision is none)."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    removed = (flag("is_content_duplicate") | flag("is_contained")) & ~flag("needs_review") & ~F.col("duplicate_review_decision").eqNullSafe("restored")
    return ~(flag("is_ignored_artifact") | flag("is_duplicate") | removed | flag("is_portfolio_container") | flag("manually_excluded"))


def review_candidate() -> Column:
    """What a person may confirm or restore: removed with confidence and not decided yet."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (flag("is_content_duplicate") | flag("is_contained")) & ~flag("needs_review") & ~flag("is_duplicate") & F.col("duplicate_review_decision").isNull()
