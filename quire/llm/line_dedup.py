"""Line dedup by winnowing over line hashes.

A run of lines counts as repeated if it has at least min_words words and the same lines stand in the same order at an
earlier place, in order of (document id, line). All lines of later repeats go. Lines are compared without white space at
their ends; lines without a word are skipped in runs, and go if they lie inside one that goes.

  winnow   the window of a line is the shortest run from it on with min_words words, and its fingerprint the smallest line
           hash in it. Windows follow from the lines alone, so two equal runs of min_words words select the same fingerprint.
  join     fingerprints that stand at one place only are dropped with their windows.
  extend   around each repeated fingerprint the run is extended as far as it can reach without becoming longer than needed:
           to the windows that hold the fingerprint, and backwards from each later line to the shortest run that ends there.
           Those are exactly the shortest runs that cover a line; a line is part of a repeated run if and only if one of them is repeated.
  delete   of equal runs all but the first place go.

Equal runs meet in an aggregation that keeps the first place, and each place is compared with that: a passage that stands in
a third of all documents costs a row a place, never a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

MIN_WORDS = 10
SPACE = r"\x20\x09-\x0D"


def _lines(docs: DataFrame) -> DataFrame:
    """(k1, k2, pos, h1, h2, w): the lines that have words."""
    split = docs.select("k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = F.regexp_replace("line", rf"^[{SPACE}]++|[{SPACE}]++$", "")
    marks = F.length(F.regexp_replace("bare", rf"[^{SPACE}]++[{SPACE}]*+", "\x01"))
    kept = split.select("k1", "k2", "pos", bare.alias("bare")).filter("bare <> ''")
    return kept.select("k1", "k2", "pos", F.xxhash64("bare").alias("h1"), F.xxhash64(F.lit("line"), "bare").alias("h2"), marks.cast("long").alias("w"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(k1, k2, start, end, fp, fpos, q1, q2): the window of each line, and the run that ends there where it is another one."""
    doc = W.partitionBy("k1", "k2")
    # Rows that repeat id and text are one document.
    once = lines.repartition("k1", "k2").withColumn("copy", F.row_number().over(W.partitionBy("k1", "k2", "pos").orderBy("pos"))).filter("copy = 1")
    counted = once.withColumn("c", F.sum("w").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    counted = counted.withColumn("p", F.col("c") - F.col("w")).withColumn("total", F.max("c").over(doc))
    ahead = doc.orderBy("p").rangeBetween(0, min_words - 1)
    back = doc.orderBy("c").rangeBetween(1 - min_words, 0)
    one = F.struct("h1", "h2")
    framed = counted.select("*", F.min(F.struct("h1", "pos")).over(ahead).alias("fp"), F.collect_list(one).over(ahead).alias("run"), F.max("pos").over(ahead).alias("end"))
    framed = framed.select("*", F.min("pos").over(back).alias("bstart"), F.collect_list(one).over(back).alias("brun"), F.first("fp").over(back).alias("bfp"), F.first("end").over(back).alias("bend"))
    key = lambda run, start, end, fp: F.struct(
        start.alias("start"), end.alias("end"), fp["h1"].alias("fp"), fp["pos"].alias("fpos"),
        F.xxhash64(run).alias("q1"), F.xxhash64(F.lit(1), run, F.size(run)).alias("q2"),
    )
    forward = F.when(F.col("total") - F.col("p") >= min_words, key(F.col("run"), F.col("pos"), F.col("end"), F.col("fp")))
    backward = F.when((F.col("c") >= min_words) & (F.col("bend") != F.col("pos")), key(F.col("brun"), F.col("bstart"), F.col("pos"), F.col("bfp")))
    both = framed.select("k1", "k2", F.explode(F.array(forward, backward)).alias("x")).filter("x is not null")
    return both.select("k1", "k2", "x.*")


def _kept_flags(later: DataFrame) -> DataFrame:
    """(k1, k2, keep): a boolean a line up to the last that goes."""
    order = W.partitionBy("k1", "k2").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    isle = later.withColumn("new", F.when(F.col("start") <= F.coalesce(reach, F.lit(-1)), 0).otherwise(1))
    isle = isle.withColumn("isle", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = isle.groupBy("k1", "k2", "isle").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    runs = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    flags = F.transform("r", lambda x, i: F.concat(
        F.array_repeat(F.lit(True), x["s"] - F.coalesce(F.get("r", i - 1)["e"], F.lit(-1)) - 1), F.array_repeat(F.lit(False), x["e"] - x["s"] + 1)))
    return runs.select("k1", "k2", F.flatten(flags).alias("keep"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without later repeats in text_col, and n_lines and n_removed (long; lines with and without words).

    Lines end at \\n. A null text stays null with 0 lines; an empty text is one line. A null id stands before all others.
    Rows that share id and text are one document and share its result; rows that share an id only follow one another in an
    order of their texts' hashes. Columns named n_lines or n_removed are replaced, others pass through. An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "lines", docs)
    first = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    keyed = docs.select(first.alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(text_col).alias("text"))
    windows = scratch.save(_windows(_lines(keyed), min_words), "windows")
    place = F.struct("k1", "k2", "fpos")
    repeated = windows.groupBy("fp").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo <> hi").select("fp")
    live = windows.join(repeated, "fp", "left_semi")
    at = F.struct("k1", "k2", "start")
    firsts = live.groupBy("q1", "q2").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last").select("q1", "q2", "first")
    later = live.join(firsts, ["q1", "q2"]).filter(at > F.col("first")).select("k1", "k2", "start", "end")
    flags = scratch.save(_kept_flags(later), "flags")
    scratch.drop("windows")
    flags = flags.withColumnsRenamed({"k1": "__lines_k1", "k2": "__lines_k2", "keep": "__lines_keep"})
    joined = docs.drop("n_lines", "n_removed").join(flags, (first == F.col("__lines_k1")) & (F.xxhash64(text_col) == F.col("__lines_k2")), "left")
    lines = F.split(text_col, "\n", -1)
    kept = F.filter(lines, lambda _, i: F.coalesce(F.get("__lines_keep", i), F.lit(True)))
    out = joined.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("__lines_keep").isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(F.filter("__lines_keep", lambda x: ~x))).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("__lines_keep").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    return out.drop("__lines_k1", "__lines_k2", "__lines_keep")
