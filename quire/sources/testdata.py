"""The driver's tables as base tables of the engine: a document is a text, its lines are its pages, its language its package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.schema import RAW_PAGES, conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.size(F.split("text", "\n", -1))
    no, none = F.lit(False), F.lit(None).cast("string")
    return docs.select(
        F.coalesce("lang", F.lit("?")).alias("package_id"), F.format_string("DOC-%06d", F.col("doc_id") + 1).alias("document_id"), (F.col("doc_id") + 1).cast("int").alias("traversal_index"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("original_filename"),
        F.octet_length("text").cast("long").alias("original_size_bytes"), F.sha2("text", 256).alias("original_sha256"), F.lit("converted").alias("status"), no.alias("is_ignored_artifact"), no.alias("is_portfolio_container"), none.alias("portfolio_parent_document_id"),
        lines.cast("int").alias("converted_page_count"), F.octet_length("text").cast("long").alias("converted_size_bytes"),
    )


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.coalesce("lang", F.lit("?")).alias("package_id"), F.format_string("DOC-%06d", F.col("doc_id") + 1).alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("page_index", "raw_text"))
    return conform(lines.withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "rotation": F.lit(0)}), RAW_PAGES)


def rehashed(pages: DataFrame) -> DataFrame:
    """(package_id, document_id, sha) of documents put together again from their pages."""
    lines = F.array_sort(F.collect_list(F.struct("page_index", "raw_text")))
    return pages.groupBy("package_id", "document_id").agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["raw_text"]), "\n"), 256).alias("sha"))


def packing_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their lines as pages, a customer as a package."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("converted_page_count"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(F.col("o_custkey").cast("string").alias("package_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("traversal_index"), "converted_page_count", F.lit(0).cast("long").alias("converted_size_bytes"))


def merged_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, documents): every document by line hash, and containers that hold all lines of ten neighbouring ids of a language."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select(F.coalesce("lang", F.lit("?")).alias("package_id"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_index", "line")).filter(F.length("line") > 3)
    lines = lines.select("package_id", "doc_id", F.struct("doc_id", "page_index").alias("at"), F.sha2("line", 256).alias("text_hash"))  # lines are long: only their hashes are dealt out
    single = lines.select("package_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("document_id"), "at", "text_hash")
    whole = lines.select("package_id", F.concat(F.lit("M"), F.floor(F.col("doc_id") / 10).cast("string")).alias("document_id"), "at", "text_hash")
    from pyspark.sql import Window as W

    both = single.unionByName(whole).withColumn("ord", F.row_number().over(W.partitionBy("package_id", "document_id").orderBy("at")) - 1)
    pages = both.select("package_id", "document_id", "ord", "text_hash")
    return pages, pages.groupBy("package_id", "document_id").agg(F.count("*").alias("non_blank_pages"))
