"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mixed_rows
from quire.llm.ngram_jaccard import ngram_jaccard_join
from quire.llm.scratch import Scratch
from quire.llm.segmentation import sample_segmentations
from quire.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go, row by row: rows that share an id, or have none, are judged each by its own text."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and with them a document that had nothing else. Rows without an id keep their text."""
    own = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    kept = dedup_lines(docs.withColumnsRenamed(own))
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8 or more stays: that with the smallest id.

    An id is a document: rows that share one stay or go together, and rows without one stay.
    """
    groups = ngram_jaccard_join(docs, k=5, num=4, den=5)
    lost = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row stands as often as the mix repeats it."""
    return mixed_rows(docs).select(docs.columns)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row, without replacement, as piece numbers; repeats of a document get their own."""
    return sample_segmentations(docs, k=2, number_copies=True)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", segmentation),
]

#: The classifier and the sampled segmentations can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
