"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents; one that may be repeated stands in its queue once a pass. A copy's
virtual finish time is the number of the source's words up to and with it, divided by the source's target. Serving all
queues by finish time, and stopping when the budget is spent, gives each source words in proportion to its target.

All steps are aggregations, joins with aggregates and windows inside hash or range buckets: a source that holds most of
the rows is spread over SHUFFLE_BUCKETS windows, and the running total over the global order is a sum over ranges of finish
time plus an exact sort inside the one range where the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

MAX_REPEATS = 3
SHUFFLE_BUCKETS = 1024
#: Ranges of finish time a round; the range where the budget ends is cut again until it holds at most SORTED_ROWS.
RANGES = 1024
SORTED_ROWS = 10_000


def n_words(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "\x01")
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), F.length(F.regexp_extract(text, r"^[\x20\x09-\x0D]++", 0))).otherwise(0)
    return F.coalesce(F.length(marks) - lead, F.lit(0)).cast("long")


def source_targets(sized: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size): weights 1, 2, 3 by code point, null last; caps refilled.

    The target is min(cap, level x weight), where the level makes the targets sum to all words; that is the fixed point of
    resharing what exceeds a cap by weight. A row a source goes through the two windows, not a row a document.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", max_repeats * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = W.partitionBy()
    upto = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    state = ranked.select(
        "*", F.sum("source_size").over(whole).alias("total"), F.sum("weight").over(whole).alias("weights"),
        F.sum("cap").over(upto).alias("capped"), F.sum("weight").over(upto).alias("used"),
    )
    #: The level if the sources before this one in order of ratio are capped and this one isn't.
    level = (F.col("total") - (F.col("capped") - F.col("cap"))).cast("double") / (F.col("weights") - (F.col("used") - F.col("weight"))).cast("double")
    state = state.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("ratio"))
    least = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("ratio"))).over(whole)
    target = F.when(F.col("ratio") < F.coalesce(least, F.col("ratio") + 1), F.col("cap").cast("double")).otherwise(least * F.col("weight"))
    return state.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) of every row; taken counts repeats and is a multiple of size.

    The budget is the number of all words. Null is a source of its own. A null or blank text has size 0 and is never taken.
    The order is a hash of the id and then of the text: rows that repeat both are interchangeable and each counts; a null id
    is an id like another. Empty tables give empty results. Other columns are ignored.
    """
    queued = _queued(docs, max_repeats, id_col, text_col, source_col)
    return queued.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes: the rows of docs, each as often as it is taken, with all their columns; repeats of a row follow one another.

    Rows meet their counts by id and text, a null id being an id like another; rows that repeat both share their counts evenly.
    """
    queued = _queued(docs, max_repeats, id_col, text_col, source_col).filter("taken > 0")
    times = queued.groupBy(F.col("key").alias("__mix_key"), F.col("tie").alias("__mix_tie")).agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("__mix_times"))
    key, tie = _keys(id_col, text_col)
    rows = docs.withColumns({"__mix_key": key, "__mix_tie": tie}).join(times, ["__mix_key", "__mix_tie"])
    same = W.partitionBy("__mix_key", "__mix_tie")
    # A row's share: all times of its group, dealt out one by one.
    rows = rows.withColumns({"__mix_nth": F.row_number().over(same.orderBy("__mix_times")), "__mix_all": F.count(F.lit(1)).over(same)})
    share = F.floor((F.col("__mix_times") - F.col("__mix_nth")) / F.col("__mix_all")) + 1
    rows = rows.withColumn("__mix_copy", share.cast("int")).filter("__mix_copy > 0")
    return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copy")))).select(docs.columns)


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A row's place in the shuffled order, and what decides between rows that share an id."""
    return F.md5(F.concat(F.lit("mix/"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), F.xxhash64(text_col)


def _queued(docs: DataFrame, max_repeats: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, key, tie, source_size, target, upto, taken) of every row."""
    scratch = Scratch(docs.sparkSession, "mix", docs)
    key, tie = _keys(id_col, text_col)
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), tie.alias("tie"))
    # Which bucket of its source's shuffled order a document is in: the leading hex digits of its key.
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("int") * SHUFFLE_BUCKETS / 65536).cast("int"))
    sized = scratch.save(sized, "sized")
    targets = source_targets(sized, max_repeats)

    # The running total of a source: totals of its buckets, then inside each bucket.
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    goals = targets.withColumnsRenamed({"source": "s"})
    offsets = offsets.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnsRenamed({"source": "s", "bucket": "b"})
    inside = W.partitionBy("source", "bucket").orderBy("key", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    queued = sized.withColumn("here", F.sum("size").over(inside))
    queued = queued.join(offsets, (F.col("bucket") == F.col("b")) & F.col("source").eqNullSafe(F.col("s"))).drop("s", "b")
    queued = scratch.save(queued.withColumn("upto", F.col("here") + F.col("offset")).drop("here", "offset", "bucket"), "queued")

    # A row a copy that may be served; its finish time depends on the document alone.
    copies = queued.filter("size > 0 and target > 0").select(
        "size", "key", "tie", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("unnamed"),
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda r: (F.col("upto") + r.cast("long") * F.col("source_size")).cast("double") / F.col("target"))).alias("finish"),
    )
    budget = sized.agg(F.sum("size")).first()[0] or 0
    last = _last_served(copies, budget)
    if last is None:
        served = F.lit(0)
    else:
        at = [F.lit(x) for x in last]
        served = F.size(F.filter(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda r: _not_after(
            [(F.col("upto") + r.cast("long") * F.col("source_size")).cast("double") / F.col("target"), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("key"), F.col("tie")], at)))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), served * F.col("size")).otherwise(0).cast("long")
    return queued.withColumn("taken", taken)


ORDER = ["finish", "unnamed", "source", "key", "tie"]


def _not_after(row: list[Column], at: list[Column]) -> Column:
    """Whether a row stands at or before a place in the lexicographic order."""
    out = F.lit(True)
    for x, y in reversed(list(zip(row, at, strict=True))):
        out = (x < y) | ((x == y) & out)
    return out


def _last_served(copies: DataFrame, budget: int):
    """The place in the global order of the last copy that the budget holds; None if it holds none.

    Each round sums the words by range of finish time and goes into the range where the budget ends, until that range is
    small enough to be sorted. A round returns at most RANGES + 1 sums.
    """
    lo, hi = copies.agg(F.min("finish"), F.max("finish")).first()
    if lo is None:
        return None
    spent, best = 0, None
    while True:
        inside = copies.filter((F.col("finish") >= lo) & (F.col("finish") <= hi))
        step = max((hi - lo) / RANGES, 1e-300)
        cut = F.least(F.lit(RANGES - 1), F.floor((F.col("finish") - lo) / step).cast("int"))
        parts = inside.groupBy(cut.alias("r")).agg(F.sum("size").alias("w"), F.count("*").alias("c"), F.min("finish").alias("f0"), F.max("finish").alias("f1"))
        for p in sorted(parts.collect()):
            if spent + p.w > budget:
                break
            spent, best = spent + p.w, p.f1
        else:
            return _place(copies, best)
        if p.c <= SORTED_ROWS or p.f0 == p.f1:
            run = W.orderBy(*ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
            near = copies.filter((F.col("finish") >= p.f0) & (F.col("finish") <= p.f1))
            fit = near.withColumn("run", F.sum("size").over(run)).filter(F.col("run") <= budget - spent)
            row = fit.agg(F.max(F.struct(*ORDER)).alias("m")).first().m
            return tuple(row) if row is not None else _place(copies, best)
        lo, hi = p.f0, p.f1


def _place(copies: DataFrame, finish: float | None):
    if finish is None:
        return None
    return tuple(copies.filter(F.col("finish") == finish).agg(F.max(F.struct(*ORDER)).alias("m")).first().m)
