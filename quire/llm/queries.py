"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import sql
from quire.llm.embedding_dedup import near_duplicate_embeddings
from quire.llm.language_id import identify_languages
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mix_sources
from quire.llm.multi_index import search
from quire.llm.ngram_jaccard import ngram_jaccard_join
from quire.llm.pii import find_pii
from quire.llm.preference import conversations_as_rows, format_preferences, pair_neighbours
from quire.llm.segmentation import sample_segmentations
from quire.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents")).drop("found")


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return search(rows, rows.filter("vec_id % 20 = 0"), k=20)


def op5_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(_table(spark, sf_dir, "documents"), k=2)


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(pair_neighbours(conversations_as_rows(_table(spark, sf_dir, "conversations"))))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_embeddings(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_mix_sources": op2_mix_sources,
        "op3_pii": op3_pii,
        "op4_multi_index": op4_multi_index,
        "op5_segmentation": op5_segmentation,
        "op6_preference": op6_preference,
        "op7_line_dedup": op7_line_dedup,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_ngram_jaccard": op10_ngram_jaccard,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": sql.OP2,
        "op6_preference": sql.OP6,
        "op7_line_dedup": sql.OP7,
        "op8_embedding_dedup": sql.OP8,
        "op10_ngram_jaccard": sql.OP10,
    }
