"""What a run writes."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY_ROWS, PRESETS = 500, 200


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet under a path that must not exist: nothing is overwritten, and Spark's committer leaves no half of it."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def next_version(spark, parent: str, name: str) -> str:
    """parent/name if it is free, else parent/name, v2 and so on; any file system that Spark reaches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    k = 1
    while True:
        path = jvm.org.apache.hadoop.fs.Path(f"{parent}/{name}" + (f", v{k}" if k > 1 else ""))
        if not path.getFileSystem(conf).exists(path):
            return path.toString()
        k += 1


def history(log: DataFrame) -> DataFrame:
    """The latest entries of a log with timestamp, newest first."""
    return log.orderBy(F.desc("timestamp")).limit(HISTORY_ROWS)


def presets(upserts: DataFrame) -> DataFrame:
    """The latest values of each lender (written_at), of the lenders that were first seen last."""
    key = F.replace(F.lower(F.trim("lender")), F.lit("ß"), F.lit("ss"))
    keyed = upserts.withColumn("key", key).groupBy("key").agg(F.max_by(F.struct(*upserts.columns), "written_at").alias("v"), F.min("written_at").alias("first_seen"))
    return keyed.orderBy(F.desc("first_seen"), "key").limit(PRESETS).select("key", "v.*")


def extracted_names(matches: DataFrame, name: str = "filename") -> DataFrame:
    """Adds copy and file: what is extracted twice under a name gets Copy 2 and so on."""
    from quire.functions.naming import with_copy_number

    nth = F.row_number().over(W.partitionBy("package_id", name).orderBy("match_id"))
    return matches.filter("extract").withColumn("copy", nth).withColumn("file", with_copy_number(F.col(name), F.col("copy"), ", Copy %d"))


def extracted_pages(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of what is extracted, numbered from 1 in each: matches of bands that are extracted (first_page to last_page, from 1) meet pages by document."""
    wanted = matches.filter("extract").select("package_id", "document_id", "match_id", "category", "first_page", "last_page")
    met = wanted.join(pages, ["package_id", "document_id"]).filter("page_index between first_page - 1 and last_page - 1")
    return met.withColumn("page", F.col("page_index") - F.col("first_page") + 2).drop("first_page", "last_page")


def unconverted_copies(occ: DataFrame) -> DataFrame:
    """(package_id, document_id, target): where originals without conversion are kept; of those that would share a place all but the first carry their id."""
    from quire.functions import naming as N

    lost = occ.filter("status = 'unconverted_placeholder'").withColumn("place", N.unconverted_path(F.coalesce("original_relative_path", F.lit(""))))
    nth = F.row_number().over(W.partitionBy("package_id", "place").orderBy("traversal_index"))
    return lost.withColumn("nth", nth).select("package_id", "document_id", F.when(F.col("nth") == 1, F.col("place")).otherwise(N.with_id(F.col("place"), F.col("document_id"))).alias("target"))


BUNDLED = "package_id string, at int, name string, target string"


def bundled(files: DataFrame) -> DataFrame:
    """Adds target to loose files (package_id, at, name) that become one folder: a name that is taken gets (2), (3) and so on before its extension.

    A number that another file bears is passed over, so names are dealt in order of at; a bundle is one task, and a handful of files.
    """

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        targets = []
        frame = frame.sort_values("at")
        for name in frame.name:
            dot = name.rfind(".")
            stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            free, k = name, 1
            while free in taken:
                k += 1
                free = f"{stem} ({k}){ext}"
            taken.add(free)
            targets.append(free)
        return frame.assign(target=targets)[["package_id", "at", "name", "target"]]

    return files.select("package_id", F.col("at").cast("int").alias("at"), "name").groupBy("package_id").applyInPandas(deal, BUNDLED)


def source_hash(files: DataFrame) -> DataFrame:
    """(package_id, hash): what a comparison was made of. files: (package_id, side 0 or 1, name, size, sha); sides and files go in natural order."""
    from quire.functions import naming as N

    one = F.concat(F.hex(F.encode("name", "utf-8")), F.hex(F.encode(F.col("size").cast("string"), "utf-8")), F.upper("sha"))
    row = F.struct("side", N.natural_key(F.col("name")).alias("key"), "name", one.alias("hex"))
    listed = files.groupBy("package_id").agg(F.array_sort(F.collect_list(row)).alias("l"))
    end = F.hex(F.encode(F.lit("|side|"), "utf-8"))
    side = lambda k: F.concat(F.array_join(F.transform(F.filter("l", lambda x: x["side"] == k), lambda x: x["hex"]), ""), end)
    return listed.select("package_id", F.sha2(F.unhex(F.concat(side(0), side(1))), 256).alias("hash"))


HISTORY = "last_name string, first_name string, loan_number string, is_adverse boolean, lender string, output_path string, status string, timestamp string, document_count int"


def history_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """The rows of a log kept as one JSON object a line. Absent fields are empty, false or 0; a line that isn't such an object goes."""
    read = F.from_json(column, HISTORY + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select(read.alias("r")).filter("r is not null and r._bad is null").select("r.*").drop("_bad")
    return rows.fillna("").fillna(0).fillna(False)


def record_decision(decisions: DataFrame, path: str) -> None:
    """Adds decisions (schema.DECISIONS) to the log under path; nothing is built again, and what a log holds is never changed."""
    decisions.write.mode("append").parquet(path)


def put_aside(spark, paths: Iterable[str], parent: str, reason: str) -> DataFrame:
    """What a cancelled run leaves: its folders move under parent (never over another), and each is a row (path, moved_to, reason); moved_to is null where nothing stood."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for path in paths:
        source = jvm.org.apache.hadoop.fs.Path(path)
        fs = source.getFileSystem(conf)
        moved = None
        if fs.exists(source):
            moved = next_version(spark, parent, source.getName())
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(parent))
            if not fs.rename(source, jvm.org.apache.hadoop.fs.Path(moved)):
                raise OSError(f"could not move {path} to {moved}")
        rows.append((path, moved, reason))
    return spark.createDataFrame(rows, "path string, moved_to string, reason string")
