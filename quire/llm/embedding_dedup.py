"""Near duplicates among embeddings by spherical-cap filters.

Filter directions form a product code: after a random rotation a vector is cut into BLOCKS parts, each part has a code of random
unit vectors, and a direction is one code word a part. List decoding finds the directions whose cap holds a vector without
trying all of them: sums of two parts are made and cut to the best, then sums of those. The cap's height is set for each
vector such that DECODED directions exceed it; with one height for all, vectors that the code covers badly have none. The DECODED best
sums come from the DECODED best of both halves, so decoding is exact.

Vectors that share a filter and a label are compared in double precision. Equal vectors are compared once, as one. A filter
with many vectors is cut into blocks of BLOCK_ROWS, and pairs of blocks are compared as matrices, so no pair becomes a row: a task
emits the number of links of each vector, counted in the first filter that the two share only, and links that span
the components of its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.batches import map_arrow
from quire.llm.components import connected_components
from quire.llm.scratch import Scratch
from quire.llm.vectors import matrix, usable

BLOCKS, CODE, DECODED = 4, 32, 32
BLOCK_ROWS, COLUMNS = 1024, 2048


def code(dim: int, seed: int = 5) -> tuple[np.ndarray, list[slice], list[np.ndarray]]:
    """A rotation, the parts and their code words."""
    rng = np.random.default_rng([seed, dim])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    at = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
    words = [rng.standard_normal((CODE, p.stop - p.start)) for p in parts]
    return rotation, parts, [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]


def _best(sums: np.ndarray, names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    if sums.shape[1] <= most:
        return sums, names
    k = np.argpartition(-sums, most - 1, axis=1)[:, :most]
    return np.take_along_axis(sums, k, 1), np.take_along_axis(names, k, 1)


def decode(X: np.ndarray, most: int = DECODED) -> np.ndarray:
    """For each row the numbers of the filters that it exceeds, sorted."""
    rotation, parts, words = code(X.shape[1])
    Y = (X / np.linalg.norm(X, axis=1, keepdims=True)) @ rotation
    sums = names = None
    for p, w in zip(parts, words, strict=True):
        s = Y[:, p] @ w.T
        n = np.broadcast_to(np.arange(len(w)), s.shape)
        s, n = _best(s, n, most)
        if sums is None:
            sums, names = s, n
        else:
            both = (sums[:, :, None] + s[:, None, :]).reshape(len(X), -1)
            sums, names = _best(both, (names[:, :, None] * CODE + n[:, None, :]).reshape(len(X), -1), most)
    return np.sort(names, axis=1)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, v, w, dim, filters)."""
    for batch in batches:
        dims = np.asarray(pa.compute.list_value_length(batch.column(2)))
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            X = matrix(part.column(2))
            filters = decode(X)
            kept = pa.ListArray.from_arrays(pa.array(np.arange(0, filters.size + 1, filters.shape[1], dtype=np.int32)), pa.array(filters.ravel().astype(np.int32)))
            raw = pa.array([x.tobytes() for x in X], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), raw, part.column(3), pa.array(np.full(len(X), d, np.int32)), kept], names=["id", "label", "v", "w", "dim", "filters"])


def _spanning(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row that it reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _meet_before(lists: list[np.ndarray], f: int) -> np.ndarray:
    """Which rows share a filter before f, COLUMNS filters at a time; filters of one row alone don't matter."""
    n = len(lists)
    shared = np.zeros((n, n), bool)
    values, owner = np.concatenate(lists), np.repeat(np.arange(n), [len(x) for x in lists])
    values, owner = values[values < f], owner[values < f]
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    held = count[at] > 1
    column, owner = (np.cumsum(count > 1) - 1)[at[held]], owner[held]
    for a in range(0, int((count > 1).sum()), COLUMNS):
        some = (column >= a) & (column < a + COLUMNS)
        M = np.zeros((n, COLUMNS), np.float32)
        M[owner[some], column[some] - a] = 1
        shared |= M @ M.T > 0
    return shared


def _compare(rows: list[tuple], f: int, cross: bool, threshold: float):
    """rows: (id, block flag, v, w, filters). Links between all rows of one block, or between two blocks."""
    ids = np.array([r[0] for r in rows], np.int64)
    side = np.array([r[1] for r in rows], bool)
    V = np.array([np.frombuffer(r[2]) for r in rows])
    V = V / np.linalg.norm(V, axis=1, keepdims=True)
    near = V @ V.T >= threshold
    np.fill_diagonal(near, False)
    if cross:
        near &= side[:, None] != side[None, :]
    if not near.any():
        return [], [], []
    first = near & ~_meet_before([np.array(r[4], np.int64) for r in rows], f)
    weight = np.array([r[3] for r in rows], np.int64)
    root = _spanning(near)
    return ids, first @ weight, ids[root]


def _blocks(threshold: float):
    """Reads rows sorted by (label, dim, f, b1, b2); compares each group, which holds at most two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done():
            if len(held) < 2:
                return None
            ids, n, roots = _compare(held, key[2], key[3] != key[4], threshold)
            if not len(ids):
                return None
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(roots)], names=["id", "n", "root"])

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[:5] != key:
                    if (out := done()) is not None:
                        yield out
                    held, key = [], r[:5]
                held.append((r[5], r[6] == r[3], r[7], r[8], r[9]))
        if (out := done()) is not None:
            yield out

    return run


def near_duplicate_embeddings(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Two rows link if their labels are equal and not null (label_col None: all rows are comparable), their vectors have one length
    and their cosine in double precision is at least threshold. Vectors that are null, empty, zero or hold null or non-finite
    numbers link with nothing: n_links 0, their own component, kept. A row with a null id links with nothing; its component
    and kept are null. Rows that share an id are one node. Equal vectors link with each other. Empty tables give empty results.
    Other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "caps", df)
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = usable(df, id_col, vec_col, [label.alias("label")]).filter("label is not null")
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    keyed = rows.select("id", "label", F.xxhash64("v").alias("q1"), F.xxhash64(F.lit(1), "v", F.size("v")).alias("q2")).distinct()
    classes = keyed.groupBy("label", "q1", "q2").agg(F.min("id").alias("rep"), F.count("*").alias("w"))
    member = scratch.save(keyed.join(classes, ["label", "q1", "q2"]).select("id", "rep", "w", "label", "q1", "q2"), "members")
    reps = member.filter("id = rep").select("id", "w", "label", "q1", "q2").distinct()
    found = rows.withColumns({"q1": F.xxhash64("v"), "q2": F.xxhash64(F.lit(1), "v", F.size("v"))}).join(reps, ["id", "label", "q1", "q2"]).dropDuplicates(["id", "label", "q1", "q2"])
    decoded = map_arrow(found.select("id", "label", "v", "w"), _decoded, "id long, label string, v binary, w long, dim int, filters array<int>")
    decoded = scratch.save(decoded, "decoded")
    # Which filters hold two vectors or more, and into how many blocks those with many are cut.
    posted = decoded.select("id", "label", "dim", F.explode("filters").alias("f"))
    shared = posted.groupBy("label", "dim", "f").agg(F.count("*").alias("c")).filter("c > 1")
    live = posted.join(shared, ["label", "dim", "f"]).withColumn("blocks", F.ceil(F.col("c") / BLOCK_ROWS).cast("int"))
    live = live.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = live.select("id", "label", "dim", "f", F.least("b", "other").alias("b1"), F.greatest("b", "other").alias("b2"), "b")
    full = paired.join(decoded.select("id", "label", "dim", "v", "w", "filters"), ["id", "label", "dim"])
    key = ["label", "dim", "f", "b1", "b2"]
    grouped = full.repartition(*key).sortWithinPartitions(*key).select(*key, "id", "b", "v", "w", "filters")
    compared = scratch.save(map_arrow(grouped, _blocks(threshold), "id long, n long, root long"), "compared")
    edges = compared.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    copies = member.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    component = connected_components(edges.unionByName(copies), scratch, "cc")
    links = compared.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
    counted = member.join(links, "rep", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n")).groupBy("id").agg(F.sum("n").alias("n"))
    out = df.select(F.col(id_col).alias("_id"), F.col(id_col).cast("long").alias("id")).join(counted, "id", "left").join(component, "id", "left")
    own = F.coalesce("component", "id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), (own == F.col("id")).alias("kept"))
