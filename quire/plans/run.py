"""A run from files to written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Config
from quire.plans import engine, reports
from quire.schema import OCCURRENCES, RAW_PAGES, conform
from quire.sources import decoders, inventory, sinks

K = ["package_id", "document_id"]


def read_folder(spark: SparkSession, path: str, config: Config, package_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences, raw pages) of the files under path; copies of a file in a package are decoded once and share the pages."""
    engine.ensure_checkpoints(spark)
    found = inventory.scan(spark, path, package_id, config.max_zip_depth).checkpoint()
    files = found.filter("content is not null and not is_ignored_artifact")
    first = files.groupBy("package_id", "original_sha256").agg(F.min("document_id").alias("document_id"))
    decoded = decoders.decode_files(files.join(first, ["package_id", "original_sha256", "document_id"], "left_semi")).checkpoint()
    source = files.join(first.withColumnRenamed("document_id", "source_id"), ["package_id", "original_sha256"]).select(*K, "source_id")
    pages = decoded.withColumnRenamed("document_id", "source_id").join(source, ["package_id", "source_id"])
    got = pages.groupBy(*K).agg(F.first("status").alias("made"), F.count("*").cast("int").alias("converted_page_count"), F.sum(F.octet_length("raw_text")).cast("long").alias("converted_size_bytes"))
    lost = found.filter("content is null and not is_ignored_artifact").select(*K, F.lit(0).alias("page_index"), F.concat_ws("\n", F.concat(F.lit("Could not be converted: "), "original_filename"), "problem").alias("raw_text"))
    occ = found.drop("content").join(got, K, "left")
    live, bare = ~F.col("is_ignored_artifact"), F.col("made").isNull()
    occ = occ.withColumns({
        "status": F.when(live, F.coalesce("made", F.lit("unconverted_placeholder"))).otherwise(F.col("status")), "converted_page_count": F.when(live & bare, 1).otherwise(F.col("converted_page_count")),
        "converted_size_bytes": F.coalesce("converted_size_bytes", F.lit(0))})
    paper = {"width": F.lit(612.0), "height": F.lit(792.0), "rotation": F.lit(0)}
    raw = pages.select(*K, "page_index", "raw_text").unionByName(lost).withColumns(paper)
    return conform(occ, OCCURRENCES), conform(raw, RAW_PAGES)


def build_folder(spark: SparkSession, path: str, config: Config | None = None, package_id: str | None = None, allow_large: bool = False, free_bytes: int | None = None, decisions: DataFrame | None = None) -> engine.PackageRun:
    """A run over the files under path, after a look at how much they expand to; afterwards the originals are read and hashed again."""
    config = config or Config()
    inventory.preflight(inventory.estimate(spark, path, package_id, config.max_zip_depth), config, allow_large, free_bytes)
    occ, raw = read_folder(spark, path, config, package_id)
    return engine.build(occ, raw, config, decisions, inventory.rehash(spark, path, package_id, config.max_zip_depth))


def written(run: engine.PackageRun, folder: str) -> dict[str, str]:
    """Writes a run's tables and reports under a folder as Parquet: name to path."""
    tables = {
        "occurrences": run.occurrences, "original_parts": run.original_parts, "final_parts": run.final_parts, "key_documents": run.key_documents, "checks": run.checks, "summary": run.success(),
        "key_document_report": reports.key_document_report(run.occurrences, run.key_documents), "duplicate_log": reports.duplicate_log(run.occurrences), "portfolios": reports.portfolio_report(run.occurrences),
        "processing_report": reports.processing_lines(run.occurrences, run.original_parts, run.final_parts, run.checks), "manifest": reports.manifest(run.occurrences),
        "extracted_pages": sinks.extracted_pages(run.key_documents, run.pages), "unconverted": sinks.unconverted_copies(run.occurrences),
    }
    if run.versions is not None:
        tables |= {"versions": reports.version_report(run.occurrences, run.versions), "overlaps": reports.overlap_report(run.overlaps), "uncertain": run.uncertain}
    for name, table in tables.items():
        sinks.write_table(table, f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in tables}
