"""Packing documents into parts of limited pages and size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def plan_parts(docs: DataFrame, max_pages: int, max_bytes: int, keys: tuple[str, ...] = ("package_id",)) -> DataFrame:
    """Adds part (from 1) in order of traversal_index: a part ends before the document that would break a limit; one that breaks it
    alone is a part of its own.

    The running sums start again with each part, so a package is followed by one task, in order and row by row: nothing of it is
    held but the sums. Packages are independent.
    """
    rows = docs.select(
        *keys, "document_id", "traversal_index",
        F.coalesce("converted_page_count", F.lit(0)).cast("long").alias("pages"), F.coalesce("converted_size_bytes", F.lit(0)).cast("long").alias("bytes"),
    )
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "traversal_index", "pages", "bytes", "document_id")
    n = len(keys)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, part, pages, size, closed = None, 0, 0, 0, True
        for batch in batches:
            out = []
            for *key, p, s in zip(*[batch.column(j).to_pylist() for j in (*range(n), n + 2, n + 3)], strict=True):
                if key != package:
                    package, part, closed = key, 0, True
                alone = p > max_pages or s > max_bytes
                if alone or closed or pages + p > max_pages or size + s > max_bytes:
                    part, pages, size = part + 1, 0, 0
                pages, size, closed = pages + p, size + s, alone
                out.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "part"])

    return ordered.mapInArrow(follow, StructType([*ordered.schema.fields, StructField("part", IntegerType())]))


def parts(members: DataFrame, max_pages: int, max_bytes: int, keys: tuple[str, ...] = ("package_id",)) -> DataFrame:
    """A row a part: documents in order, totals, whether it is one document over a limit, and why it ended."""
    rows = F.array_sort(F.collect_list(F.struct("traversal_index", "document_id", "pages", "bytes")))
    got = members.groupBy(*keys, "part").agg(rows.alias("m"), F.sum("pages").alias("page_count"), F.sum("bytes").alias("file_size_bytes"))
    got = got.withColumn("n_documents", F.size("m")).withColumn("is_oversized", (F.col("n_documents") == 1) & ((F.col("page_count") > max_pages) | (F.col("file_size_bytes") > max_bytes)))
    after = F.lead(F.get("m", F.lit(0))).over(W.partitionBy(*keys).orderBy("part"))
    got = got.withColumn("after", after)
    reasons = F.filter(F.array(
        F.when(F.col("is_oversized"), "oversized_document"), F.when(F.col("after").isNull(), "end_of_package"),
        F.when(F.col("page_count") + F.col("after.pages") > max_pages, "page_maximum"), F.when(F.col("file_size_bytes") + F.col("after.bytes") > max_bytes, "size_maximum")), lambda x: x.isNotNull())
    got = got.withColumn("close_reasons", F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("end_of_package"))))
    return got.withColumn("document_ids", F.transform("m", lambda x: x["document_id"])).drop("m", "after")


def offsets(members: DataFrame, keys: tuple[str, ...] = ("package_id",)) -> DataFrame:
    """Adds offset_in_part and offset_overall: pages before a document in its part, and in the package."""
    before = lambda *by: F.coalesce(F.sum("pages").over(W.partitionBy(*by).orderBy("traversal_index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return members.withColumn("offset_in_part", before(*keys, "part")).withColumn("offset_overall", before(*keys))


REBUILT = "package_id string, document_id string, bytes long, position int, part int"


def rebuilt(members: DataFrame, actual_bytes: DataFrame, max_bytes: int) -> DataFrame:
    """The parts of a plan when documents have the sizes of actual_bytes (package_id, document_id, bytes).

    From the first part on, what makes a part too large goes, last document first, to the front of the next one; the first document of a part always
    stays. Page limits aren't looked at again. A size that isn't given is the planned one. Packages are independent, a package is one task.
    """
    sized = members.select("package_id", "document_id", "traversal_index", "part", F.col("bytes").alias("planned")).join(actual_bytes.select("package_id", "document_id", F.col("bytes").alias("real")), ["package_id", "document_id"], "left")
    sized = sized.select("package_id", "document_id", "traversal_index", "part", F.coalesce("real", "planned", F.lit(0)).cast("long").alias("bytes"))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "traversal_index", "document_id"])
        planned = [list(zip(g.document_id, g.bytes)) for _, g in frame.groupby("part")]
        out, over, part = [], [], 0
        while part < len(planned) or over:
            rows = over + (planned[part] if part < len(planned) else [])
            total, fit = sum(size for _, size in rows), len(rows)
            while fit > 1 and total > max_bytes:
                fit -= 1
                total -= rows[fit][1]
            part += 1
            out += [(d, size, k, part) for k, (d, size) in enumerate(rows[:fit], 1)]
            over = rows[fit:]
        done = pd.DataFrame(out, columns=["document_id", "bytes", "position", "part"])
        done.insert(0, "package_id", frame.package_id.iloc[0])
        return done.astype({"position": "int32", "part": "int32"})

    return sized.groupBy("package_id").applyInPandas(settle, REBUILT)
