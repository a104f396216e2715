"""Inventory of a folder, an archive or a file as occurrences.

Archives are opened where they stand, entries in the order of their directory, nested ones at their place; every entry
is a row, also one that is ignored, unsafe, unreadable or too deep. A row's position is the path of places that leads to it.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import naming as N

# Fixed values.
MAX_DEPTH = 25
ZIP_MAGIC = b"PK\x03\x04"
OFFICE = (".docx", ".xlsx", ".pptx")

#: Content that is handed on at once.
BATCH_BYTES = 32 << 20

ENTRIES = "root string, path string, position array<int>, chain string, size long, sha string, problem string, content binary"


def _entries(root: str, path: str, data: bytes, position: list[int], chain: list[str], depth: int, limit: int) -> Iterator[tuple]:
    if data[:4] == ZIP_MAGIC and not path.lower().endswith(OFFICE):
        if depth >= limit:
            yield root, path, position, " > ".join(chain), len(data), hashlib.sha256(data).hexdigest(), "archives nested too deep", None
            return
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for k, info in enumerate(z.infolist()):
                    if info.is_dir():
                        continue
                    try:
                        inner = z.read(info)
                    except Exception as error:
                        yield root, info.filename, [*position, k], " > ".join([*chain, path]), None, None, f"unreadable entry: {error}", None
                        continue
                    yield from _entries(root, info.filename, inner, [*position, k], [*chain, path], depth + 1, limit)
            return
        except zipfile.BadZipFile as error:
            yield root, path, position, " > ".join(chain), len(data), hashlib.sha256(data).hexdigest(), f"corrupt archive: {error}", None
            return
    yield root, path, position, " > ".join(chain), len(data), hashlib.sha256(data).hexdigest(), None, data


def _batches(entries: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Entries in lists of BATCH_BYTES or a little more, so an archive is never unpacked as a whole."""
    rows, held = [], 0
    for row in entries:
        rows.append(row)
        held += len(row[7] or b"")
        if held >= BATCH_BYTES:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _opened(limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                for rows in _batches(_entries(r.root, r.path, bytes(r.content), [int(r.at)], [], 0, limit)):
                    yield pd.DataFrame(rows, columns=["root", "path", "position", "chain", "size", "sha", "problem", "content"]).astype({"size": "Int64"})

    return run


def _rooted(found: DataFrame, path: str, package_id: str | None) -> DataFrame:
    """(path, content, root): paths below path, and the packages that they belong to."""
    cut = F.when(F.instr("path", path.rstrip("/") + "/") > 0, F.substring_index("path", path.rstrip("/") + "/", -1)).otherwise(F.element_at(F.split("path", "/"), -1))
    return found.select(cut.alias("path"), "content").withColumn("root", F.lit(package_id) if package_id else F.split("path", "/")[0])


def scan(spark: SparkSession, path: str, package_id: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Occurrences with content of every file under path (a folder, an archive or a file; any file system that Spark reads).

    package_id null: the first folder below path names the package. Order is natural by relative path, then position in archives.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = _rooted(found, path, package_id)
    files = files.withColumn("at", F.row_number().over(W.partitionBy("root").orderBy(N.natural_key(F.col("path")))))
    rows = files.select("root", "path", "at", "content").mapInPandas(_opened(max_depth), ENTRIES)
    order = W.partitionBy("root").orderBy("position")
    ignored = N.is_artifact(F.col("path"))
    rows = rows.withColumn("traversal_index", F.row_number().over(order))
    return rows.select(
        F.col("root").alias("package_id"), F.format_string("DOC-%06d", "traversal_index").alias("document_id"), "traversal_index", F.element_at(F.split("path", r"[/\\]"), -1).alias("original_filename"),
        N.safe_path(F.col("path")).alias("original_relative_path"), N.extension(F.col("path")).alias("original_extension"), F.col("size").alias("original_size_bytes"), F.col("sha").alias("original_sha256"),
        F.when(ignored, "ignored_system_artifact").when(F.col("problem").isNotNull(), "unconverted_placeholder").otherwise("discovered").alias("status"), ignored.alias("is_ignored_artifact"), F.col("chain").alias("archive_chain_display"), "problem", "content",
    )


def rehash(spark: SparkSession, path: str, package_id: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(package_id, document_id, sha) of what stands under path now, read again."""
    return scan(spark, path, package_id, max_depth).select("package_id", "document_id", F.col("original_sha256").alias("sha"))


class InputTooLarge(ValueError):
    """The input expands to more bytes or entries than settings allow."""


class NotEnoughSpace(OSError):
    """Less space is free than a run may need."""


def _directory(data: bytes, depth: int, limit: int) -> tuple[int, int]:
    """(entries, bytes) by the directories of an archive and of those inside it; an archive inside counts itself and what it holds."""
    entries = size = 0
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                entries, size = entries + 1, size + info.file_size
                if depth < limit and info.filename.lower().endswith(".zip"):
                    more = _directory(z.read(info), depth + 1, limit)
                    entries, size = entries + more[0], size + more[1]
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):  # what can't be read is met again, and reported, by scan()
        pass
    return entries, size


def estimate(spark: SparkSession, path: str, package_id: str | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(package_id, entries, bytes) of what scan() would unpack, by archives' directories; only archives inside archives are unpacked for it."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                data = bytes(r.content)
                zipped = data[:4] == ZIP_MAGIC and not r.path.lower().endswith(OFFICE)
                inside = _directory(data, 0, max_depth) if zipped else (0, 0)
                rows.append((r.root, 1 + inside[0], len(data) + inside[1]))
            yield pd.DataFrame(rows, columns=["package_id", "entries", "bytes"])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = _rooted(found, path, package_id).select("root", "path", "content").mapInPandas(count, "package_id string, entries long, bytes long")
    return rows.groupBy("package_id").agg(F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))


def preflight(expected: DataFrame, config: Config, allow_large: bool = False, free_bytes: int | None = None) -> tuple[int, int]:
    """(entries, bytes) in all of estimate(). Raises if they are beyond the settings (unless large inputs are allowed) or free space is short."""
    got = expected.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    most = config.max_expanded_size_mb * 1024 * 1024
    if not allow_large and (got["bytes"] > most or got["entries"] > config.max_entries):
        raise InputTooLarge(f"{got['entries']} entries and {got['bytes']} bytes; allowed are {config.max_entries} and {most}")
    if free_bytes is not None and free_bytes < got["bytes"] * config.disk_multiplier:
        raise NotEnoughSpace(f"{free_bytes} bytes are free; {got['bytes'] * config.disk_multiplier:.0f} may be needed")
    return got["entries"], got["bytes"]


def enforced(occ: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """The occurrences, if every package is within limits; else the query fails as it meets the first entry beyond them."""
    told = F.concat(F.lit("package "), F.col("package_id"), F.lit(" is larger than allowed at "), F.col("document_id"))
    return over_limits(occ, max_entries, max_bytes).filter(F.when(F.col("admitted"), True).otherwise(F.raise_error(told).cast("boolean"))).drop("admitted")


def over_limits(occ: DataFrame, max_entries: int, max_bytes: int) -> DataFrame:
    """Adds admitted: whether the running number of entries and bytes is still within limits."""
    run = W.partitionBy("package_id").orderBy("traversal_index").rowsBetween(W.unboundedPreceding, 0)
    return occ.withColumn("admitted", (F.count("*").over(run) <= max_entries) & (F.coalesce(F.sum("original_size_bytes").over(run), F.lit(0)) <= max_bytes))


def expand_portfolios(occ: DataFrame, attachments: DataFrame) -> DataFrame:
    """Puts attachments (package_id, document_id, position, filename, sha, size) right after their parents and numbers all again.

    A parent of an attachment is a container only if it is marked as a collection (is_collection); children are DOC-...-PF-001 and so on.
    """
    has = attachments.select("package_id", "document_id").distinct().withColumn("_has", F.lit(True))
    parents = occ.join(has, ["package_id", "document_id"], "left").withColumn("is_portfolio_container", F.coalesce("is_collection", F.lit(False)) & F.col("_has").isNotNull()).drop("_has")
    nth = F.row_number().over(W.partitionBy("package_id", "document_id").orderBy("position"))
    children = attachments.withColumn("k", nth).join(occ.select("package_id", "document_id", "traversal_index"), ["package_id", "document_id"])
    children = children.select("package_id", F.format_string("%s-PF-%03d", "document_id", "k").alias("document_id"), "traversal_index", "k", F.col("filename").alias("original_filename"), F.col("sha").alias("original_sha256"), F.col("size").alias("original_size_bytes"), F.col("document_id").alias("portfolio_parent_document_id"))
    both = parents.withColumn("k", F.lit(0)).unionByName(children, allowMissingColumns=True)
    order = W.partitionBy("package_id").orderBy("traversal_index", "k")
    filled = both.withColumn("traversal_index", F.row_number().over(order)).drop("k")
    return filled.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_portfolio_container", "is_ignored_artifact") if c in filled.columns})
