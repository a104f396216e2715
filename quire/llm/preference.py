"""Chat formatting of preference pairs.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once, as the prompt; what follows in each is
its completion. A completion's mask says which characters count in training: those of assistant turns, with the mark that ends
them. Everything is DataFrame functions, one aggregation a conversation and one a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.scratch import Scratch

#: Neighbouring ids that are numbered together: a first turn that most conversations share is no hot group.
BLOCK = 256


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    """A turn with its marks; a mark inside a text is broken up, so a text can't end its turn."""
    return F.concat(_head(turn), F.replace(turn["text"], F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column) -> Column:
    """start-end of what counts, comma-joined: characters of the rendered turns, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.length(_rendered(t))
        span = F.concat_ws("-", (acc["at"] + F.length(_head(t))).cast("string"), (end - 1).cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["out"]), ",")


def shared_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common from the first on."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    same = lambda acc, x: F.struct((acc["n"] + F.when(acc["on"] & x, 1).otherwise(0)).alias("n"), (acc["on"] & x).alias("on"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), start, same, lambda acc: acc["n"])


def conversations_as_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order of number, then role, then text; equal rows count once, null roles are user, null texts empty."""
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = turns.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_set(one)).alias("turns"))
    return found.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def pair_conversations(rows: DataFrame, whole: bool = False) -> DataFrame:
    """(chosen_id, chosen_turns, rejected_id, rejected_turns) of conversations that begin with the same turn.

    In the whole table, or else in a block of BLOCK ids, those with one first turn are paired in order of id: first with second,
    third with fourth. The one with more characters in assistant turns is chosen, the smaller id if equal. One that is left over is
    chosen, against none.
    """
    spoken = F.aggregate("turns", F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    first = F.sha2(F.concat_ws("\x00", F.get("turns", F.lit(0))["role"], F.get("turns", F.lit(0))["text"]), 256)
    keyed = rows.withColumn("key", first).withColumn("block", F.floor(F.col("conv_id") / BLOCK))
    order = F.row_number().over(W.partitionBy("key", "block").orderBy("conv_id")).cast("long")
    group = ["key", "pair"] if whole else ["key", "block", "pair"]
    keyed = keyed.withColumn("nth", order - 1)
    if whole:  # a number inside the block and how many come before the block; only a row a block goes through the second window
        before = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        offsets = keyed.groupBy("key", "block").agg(F.count("*").alias("n")).select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        keyed = keyed.join(offsets, ["key", "block"]).withColumn("nth", F.col("nth") + F.col("offset"))
    keyed = keyed.withColumn("pair", F.floor(F.col("nth") / 2))
    one = F.struct((-spoken).alias("less"), F.col("conv_id").alias("id"), F.col("turns").alias("turns"))
    both = keyed.groupBy(*group).agg(F.array_sort(F.collect_list(one)).alias("p"))
    best, other = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return both.select(best["id"].alias("chosen_id"), best["turns"].alias("chosen_turns"), other["id"].alias("rejected_id"), other["turns"].alias("rejected_turns"))


def pair_neighbours(rows: DataFrame) -> DataFrame:
    """(chosen_id, chosen_turns, rejected_id, rejected_turns): all conversations in pairs that have as many turns in common as such pairs can.

    Conversations stand in the order of their turns' hashes, turn by turn, then of id; first with second, third with fourth. So those
    that begin alike stand together, and what a group of an odd number leaves over meets the next group, with fewer common
    turns or none. The one with more characters in assistant turns is chosen, the smaller id if equal. Of an odd number of
    conversations the last is chosen, against none. Ids are taken to be unique; an empty table gives no pair.

    The order is a sort by ranges that ends with the id: a first turn that most conversations share is split like any other. Only
    hashes are sorted; a row a range goes through a window without keys.
    """
    scratch = Scratch(rows.sparkSession, "pairs", rows)
    spoken = F.aggregate("turns", F.lit(0), lambda n, t: n + F.when(t["role"] == "assistant", F.length(t["text"])).otherwise(0))
    hashes = F.transform("turns", lambda t: F.md5(F.concat_ws("\x1f", t["role"], t["text"]).cast("binary")))
    kept = scratch.save(rows.select("conv_id", "turns", spoken.alias("spoken"), hashes.alias("key")), "rows")
    ranged = kept.select("conv_id", "key").repartitionByRange("key", "conv_id").withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged", whole=True)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("key", "conv_id")) - 1
    pairs = ranged.withColumn("nth", nth).join(offsets, "part").select("conv_id", F.floor((F.col("nth") + F.col("offset")) / 2).alias("pair"))
    one = F.struct((-F.col("spoken")).alias("less"), F.col("conv_id").alias("id"), F.col("turns").alias("turns"))
    both = kept.join(pairs, "conv_id").groupBy("pair").agg(F.array_sort(F.collect_list(one)).alias("p"))
    best, other = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return both.select(best["id"].alias("chosen_id"), best["turns"].alias("chosen_turns"), other["id"].alias("rejected_id"), other["turns"].alias("rejected_turns"))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask) of every pair.

    Equal conversations share all turns and have empty completions. Without a rejected conversation (null) the prompt is what
    comes before the first assistant turn, and rejected and its mask are null. An empty conversation renders as an empty text.
    """
    lead = F.size(F.filter("chosen_turns", lambda t, i: ~F.exists(F.slice("chosen_turns", 1, i + 1), lambda x: x["role"] == "assistant")))
    alone = F.col("rejected_turns").isNull()
    df = pairs.withColumn("n_shared", F.when(alone, lead).otherwise(shared_turns(F.col("chosen_turns"), F.col("rejected_turns"))))
    rest = lambda c: F.slice(c, F.col("n_shared") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n_shared")))
    df = df.withColumns({"c": rest("chosen_turns"), "r": F.when(~alone, rest("rejected_turns"))})
    return df.select(
        "chosen_id", "rejected_id", F.col("n_shared").cast("long").alias("n_shared"), render(F.slice("chosen_turns", F.lit(1), F.col("n_shared"))).alias("prompt"),
        render(F.col("c")).alias("chosen"), F.when(~alone, render(F.col("r"))).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), F.when(~alone, mask(F.col("r"))).alias("rejected_mask"),
    )
