"""Approximate nearest neighbours by inner product with an inverted multi-index.

The largest inner product becomes the smallest distance: every vector gets one more component that makes all of one length,
queries get 0 there. Two halves are quantised separately by CENTROIDS centroids each, fitted on a bounded sample, so
CENTROIDS squared cells are told apart. A query's cells are visited in order of the sum of the two centroid distances, with a heap,
until they hold enough vectors; those are reranked by the inner product itself in double precision.

Cells are cut into blocks of BLOCK_ROWS vectors, small ones share a block. A block's vectors travel once; the queries that visit it follow
them, a batch at a time, so neither a cell that holds a third of all vectors nor the number of queries decides a task's memory.
What grows faster than the table is the number of visits: queries times blocks times SHARE. A smaller share visits less and finds
less; share=1 visits all and is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.batches import map_arrow
from quire.llm.scratch import Scratch
from quire.llm.vectors import dots, matrix, usable

CENTROIDS = 128
#: The centroids are fitted on at most this many vectors, those with the smallest hash of their id.
SAMPLE = 20_000
#: A query visits cells until they hold so large a share of all vectors, and so many vectors for each one that it wants.
SHARE, PER_RESULT = 0.4, 20
BLOCK_ROWS, QUERY_ROWS = 8192, 256


def fit(X: np.ndarray, k: int, seed: int = 3, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; a centroid without rows stays where it is."""
    rng = np.random.default_rng(seed)
    C = X[rng.choice(len(X), min(k, len(X)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(X, C)
        n = np.bincount(at, minlength=len(C))
        total = np.zeros_like(C)
        np.add.at(total, at, X)
        C = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], C)
    return C


def distances(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    return np.maximum(0, (X**2).sum(1)[:, None] + (C**2).sum(1)[None, :] - 2 * X @ C.T)


def nearest(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    return distances(X, C).argmin(1)


def halves(X: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = X.shape[1] // 2
    return X[:, :cut], np.concatenate([X[:, cut:], extra[:, None]], 1)


def cells_in_order(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells by the sum of their two distances until they hold enough vectors (the multi-sequence algorithm)."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    s1, s2, n1, n2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, reached, out, held, width = [(s1[0] + s2[0], 0, 0)], [-1] * len(s1), [], 0, len(s2)
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        reached[i] = j
        cell = n1[i] * width + n2[j]
        if c := counts[cell]:
            out.append(cell)
            held += c
        # A cell is pushed once both cells before it were visited.
        if i + 1 < len(s1) and reached[i + 1] == j - 1:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < width and (i == 0 or reached[i - 1] > j):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def _assigner(C1: np.ndarray, C2: np.ndarray, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            X = matrix(batch.column(1))
            if not len(X):
                continue
            a, b = halves(X, np.sqrt(np.maximum(0, longest**2 - (X**2).sum(1))))
            cell = nearest(a, C1) * len(C2) + nearest(b, C2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in X], pa.binary())], names=["id", "cell", "v"])

    return run


def _router(C1: np.ndarray, C2: np.ndarray, counts: np.ndarray, blocks: dict[int, list[int]], enough: int):
    """A row a query and block that it visits, with the cells that it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counts.tolist()
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            X = np.array([np.frombuffer(v) for v in raw])
            if not len(X):
                continue
            a, b = halves(X, np.zeros(len(X)))
            D1, D2 = distances(a, C1), distances(b, C2)
            qs, bs, vs, cs = [], [], [], []
            for i, q in enumerate(ids):
                seen: dict[int, list[int]] = {}
                for cell in cells_in_order(D1[i], D2[i], known, enough):
                    for g in blocks[cell]:
                        seen.setdefault(g, []).append(cell)
                for g, cells in seen.items():
                    qs.append(q), bs.append(g), vs.append(raw[i]), cs.append(np.array(cells, np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bs, pa.int32()), pa.array(qs, pa.int64()), pa.array(vs, pa.binary()), pa.array(cs, pa.binary())], names=["block", "q", "qv", "cells"])

    return run


def _best_of(E: np.ndarray, ids: np.ndarray, cell: np.ndarray, Q: np.ndarray, qid: np.ndarray, may: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best of a block for each query, among the vectors in cells that it visits. may: query by cell."""
    out: tuple[list, list, list] = [], [], []
    S = Q @ E.T
    S[~may[:, cell] | (qid[:, None] == ids[None, :])] = -np.inf
    least = np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k] if S.shape[1] > k else np.full(len(S), -np.inf)
    # What rounding may have put on the wrong side is kept and scored again in one fixed order.
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    for i in range(len(Q)):
        near = np.flatnonzero((S[i] >= least[i] - slack[i]) & np.isfinite(S[i]))
        score = dots(E[near], Q[i])
        best = np.lexsort((ids[near], -score))[:k]
        out[0].extend([int(qid[i])] * len(best)), out[1].extend(ids[near][best].tolist()), out[2].extend(score[best].tolist())
    return out


def _ranker(k: int, n_cells: int):
    """Reads rows sorted by block, a block's vectors (kind 0) before its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, E = None, [], None
        for batch in batches:
            blocks, kinds, ids = (np.asarray(batch.column(j)) for j in range(3))
            edge = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if blocks[a] != block:
                    block, held, E = blocks[a], [], None
                part = batch.slice(a, b - a)
                X = np.array([np.frombuffer(v) for v in part.column(4).to_pylist()])
                if kinds[a] == 0:
                    held.append((X, ids[a:b], np.asarray(part.column(3))))
                    continue
                if not held:
                    continue
                if E is None:
                    E = [np.concatenate([h[j] for h in held]) for j in range(3)]
                for c in range(0, len(X), QUERY_ROWS):
                    some = part.column(5).slice(c, QUERY_ROWS).to_pylist()
                    may = np.zeros((len(some), n_cells), bool)
                    for i, cells in enumerate(some):
                        may[i, np.frombuffer(cells, np.int32)] = True
                    q, found, score = _best_of(*E, X[c : c + QUERY_ROWS], ids[a:b][c : c + QUERY_ROWS], may, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=["q", "id", "score"])

    return run


def search(df: DataFrame, queries: DataFrame, k: int = 20, least: int | None = None, share: float = SHARE, centroids: int = CENTROIDS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of df found with the largest inner product, its own id aside.

    Nearest first, ties to the smaller id, ranks from 1; all candidates if there are fewer than k. Vectors that are null, empty,
    zero or hold null or non-finite numbers take no part, nor do those of another length than the most frequent one (ties: the
    longer), nor rows with a null id. Rows that share an id count as one candidate a distinct vector, and the best one is kept.
    With no rows or no queries the result is empty. Other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "multi", df)
    rows, asked = usable(df, id_col, vec_col), usable(queries, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    shape = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
    if shape is None:
        return spark.createDataFrame([], schema)
    rows, asked, longest = rows.filter(F.size("v") == shape.d), asked.filter(F.size("v") == shape.d), float(np.sqrt(shape.m))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()  # at most SAMPLE rows
    X = np.array([r.v for r in sample], float)
    a, b = halves(X, np.sqrt(np.maximum(0, longest**2 - (X**2).sum(1))))
    C1, C2 = fit(a, centroids), fit(b, centroids, seed=4)
    assigned = map_arrow(rows.dropDuplicates(["id", "v"]), _assigner(C1, C2, longest), "id long, cell int, v binary")
    cells = scratch.save(assigned, "cells")
    # An id with several vectors may take several places of a block's best.
    places = k * int(cells.groupBy("id").count().agg(F.max("count")).first()[0])

    counts = np.zeros(len(C1) * len(C2), np.int64)
    for r in cells.groupBy("cell").count().collect():  # at most centroids squared rows
        counts[r.cell] = r["count"]
    blocks, parts, g, filled = {}, np.ones(len(counts), int), 0, 0
    for cell in np.flatnonzero(counts).tolist():
        if counts[cell] > BLOCK_ROWS:
            parts[cell] = -(-counts[cell] // BLOCK_ROWS)
            g += filled > 0
            blocks[cell], filled = list(range(g, g + parts[cell])), 0
            g += parts[cell]
        else:
            if filled + counts[cell] > BLOCK_ROWS:
                g, filled = g + 1, 0
            blocks[cell], filled = [g], filled + counts[cell]
    enough = max(PER_RESULT * k if least is None else least, int(share * int(counts.sum())))
    plan = spark.createDataFrame([(c, bs[0], len(bs)) for c, bs in blocks.items()], "cell int, first int, parts int")
    entries = cells.join(F.broadcast(plan), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int"))
    none = F.lit(None).cast("binary")
    entries = entries.select("block", F.lit(0).alias("kind"), "id", "cell", "v", none.alias("cells"))
    encoded = map_arrow(asked, _assigner(C1, C2, longest), "id long, cell int, v binary").select("id", "v")
    routed = map_arrow(encoded, _router(C1, C2, counts, blocks, enough), "block int, q long, qv binary, cells binary")
    routed = routed.select("block", F.lit(1).alias("kind"), F.col("q").alias("id"), F.lit(-1).alias("cell"), F.col("qv").alias("v"), "cells")
    both = entries.unionByName(routed).repartition("block").sortWithinPartitions("block", "kind", "id")
    ranked = map_arrow(both, _ranker(places, len(counts)), "q long, id long, score double")
    best = ranked.groupBy("q", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
