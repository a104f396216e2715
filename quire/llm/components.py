"""Connected components: local forests, then one task if few edges are left, else alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import map_arrow
from quire.llm.scratch import Scratch

#: A graph whose forests have at most so many edges is finished in one task (16 bytes an edge, about ten arrays of them).
ONE_TASK = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges (a, b), sorted, and the smallest that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        # The root of each end's tree hangs below the smaller label; then paths are halved until all are stars.
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            return ids, ids[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as stars: as many as ends, however many came in. Stars are merged whenever ONE_TASK edges are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n, least = 0, ONE_TASK

    def merged() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([h[j] for h in held]) if held else np.zeros(0, np.int64) for j in range(2))
        ids, root = smallest_reachable(a, b)
        own = ids != root
        return ids[own], root[own]

    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        n += len(batch)
        if n > least:
            held = [merged()]
            n = len(held[0][0])
            least = ONE_TASK + 2 * n
    a, b = merged()
    for at in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], names=["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) can reach; ids without edges don't appear.

    Each task first turns its edges into stars. If at most one_task edges are left, one task finishes them. Else groups are
    only reduced to their minimum before they meet the edges again, so a hub of any degree is a partial aggregation and a join,
    never one task's list. Each round is written to the shared folder, so the lineage stays short.
    """
    schema = "a long, b long"
    now, count = scratch.counted(map_arrow(edges.select("a", "b").filter("a <> b"), _forest, schema), f"{name}0")
    if count <= one_task:
        after = scratch.save(map_arrow(now.coalesce(1), _forest, schema), f"{name}1")
        scratch.drop(f"{name}0")
        now = after
    else:
        now = _star_steps(now, scratch, name)
    pairs = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return pairs.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _star_steps(now: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    before, k = None, 0
    while True:
        k += 1
        after = scratch.save(_small_star(_large_star(now)), f"{name}{k}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{k - 1}")
        now = after
        if state == before or state[0] == 0:
            return now
        before = state
