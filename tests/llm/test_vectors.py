"""Vector search and vector dedup against brute force."""

import os

import numpy as np
import pytest
from quire.llm.embedding_dedup import decode, near_duplicate_embeddings
from quire.llm.multi_index import cells_in_order, search

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def rows_of(seed=0, n=260, d=24):
    rng = np.random.default_rng(seed)
    V = rng.standard_normal((n, d)).astype(np.float32)
    for i in range(0, 120, 3):
        V[i + 1] = V[i] + 0.05 * rng.standard_normal(d)
    V[200:240] = V[5]
    return [(i, [float(x) for x in v], i % 2 if i < 120 else 1, "s") for i, v in enumerate(V)]


@pytest.fixture
def odd():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1, "s"), (901, [0.0] * 24, 1, "s"), (902, [nan] * 24, 1, "s"), (903, [inf] + [1.0] * 23, 1, "s"), (904, [None] + [1.0] * 23, 1, "s"), (905, [], 1, "s"), (906, [1.0, 2.0], 1, "s"), (None, [1.0] * 24, 1, "s")]


def test_search(spark, odd):
    rows = rows_of()
    df = spark.createDataFrame(rows + odd + [rows[9]], SCHEMA)
    got = search(df, df.filter("vec_id % 20 = 0"), k=7, least=10**6).collect()
    V = np.array([r[1] for r in rows], np.float32).astype(float)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == [i for i in range(260) if i % 20 == 0]
    for q, found in by.items():
        s = (V * V[q]).sum(1)
        want = sorted((i for i in range(260) if i != q), key=lambda i: (-round(s[i], 9), i))[:7]
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == want
        assert [r.rank for r in sorted(found, key=lambda r: r.rank)] == list(range(1, 8))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
    assert search(df.limit(0), df.limit(0)).collect() == []


def test_search_reaches_recall_with_few_cells(spark):
    rows = rows_of(3, 3000, 16)
    df = spark.createDataFrame(rows, SCHEMA)
    got = search(df, df.filter("vec_id % 100 = 0"), k=10, least=1500, share=0.5, centroids=16).collect()
    V = np.array([r[1] for r in rows], np.float32).astype(float)
    found = {(r.query_id, r.vec_id) for r in got}
    hits = 0
    for q in range(0, 3000, 100):
        s = (V * V[q]).sum(1)
        s[q] = -np.inf
        hits += sum((q, int(i)) in found for i in np.argsort(-s, kind="stable")[:10])
    assert hits / 300 >= 0.9


def recall(spark, df, ids, V, **settings):
    """The share of the 20 nearest of each query that search() finds; equal scores count as found."""
    got = search(df, df.filter("vec_id % 20 = 0"), k=20, **settings).collect()
    asked = np.flatnonzero(ids % 20 == 0)
    S = V[asked] @ V.T
    S[np.arange(len(asked)), asked] = -np.inf
    bar = dict(zip(ids[asked].tolist(), np.sort(S, axis=1)[:, -20].tolist(), strict=True))
    assert len({(r.query_id, r.vec_id) for r in got}) == len(got) == 20 * len(asked)
    return sum(r.score >= bar[r.query_id] - 1e-12 for r in got) / len(got)


def test_search_reaches_recall_as_it_is_set(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 48)) * 0.7
    V = (centres[rng.integers(0, 12, 4000)] + rng.standard_normal((4000, 48))).astype(np.float32).astype(float)
    V /= np.linalg.norm(V, axis=1, keepdims=True)
    V = V.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in v], 1, "s") for i, v in enumerate(V)], SCHEMA)
    assert recall(spark, df, np.arange(4000), V) >= 0.9
    assert recall(spark, df, np.arange(4000), V, share=1.0) == 1.0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="needs the driver's tables")
def test_search_reaches_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    assert recall(spark, df, np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)) >= 0.9


def test_cells_come_in_order_of_summed_distance():
    rng = np.random.default_rng(1)
    a, b = rng.random(6), rng.random(5)
    cells = cells_in_order(a, b, [1] * 30, 30)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)


def test_decoding_finds_the_best_filters():
    X = np.random.default_rng(2).standard_normal((5, 8))
    from quire.llm.embedding_dedup import code

    rotation, parts, words = code(8)
    Y = (X / np.linalg.norm(X, axis=1, keepdims=True)) @ rotation
    for i, got in enumerate(decode(X)):
        total = np.zeros(1)
        for p, w in zip(parts, words, strict=True):
            total = (total[:, None] + (w @ Y[i, p])[None, :]).ravel()
        assert set(got.tolist()) == set(np.argsort(-total)[: len(got)].tolist())


def test_rows_that_meet_before_a_filter():
    from quire.llm import embedding_dedup as E

    rng = np.random.default_rng(4)
    lists = [np.sort(rng.choice(9000, 40, replace=False)) for _ in range(300)]
    got = E._meet_before(lists, 6000)
    want = np.array([[bool(set(x[x < 6000].tolist()) & set(y[y < 6000].tolist())) for y in lists] for x in lists])
    off = ~np.eye(300, dtype=bool)
    assert (got[off] == want[off]).all() and not E._meet_before(lists, 0).any()


def test_filters_meet_at_the_threshold():
    """Of pairs with cosine 0.98 exactly, next to none share no filter."""
    rng = np.random.default_rng(3)
    X, N = rng.standard_normal((2, 4000, 64))
    X /= np.linalg.norm(X, axis=1, keepdims=True)
    N -= (N * X).sum(1, keepdims=True) * X
    N /= np.linalg.norm(N, axis=1, keepdims=True)
    A, B = decode(X), decode(0.98 * X + np.sqrt(1 - 0.98**2) * N)
    assert sum(not np.intersect1d(a, b).size for a, b in zip(A, B, strict=True)) <= 4


def test_near_duplicates(spark, odd):
    rows = rows_of()
    df = spark.createDataFrame(rows + odd + [(950, rows[0][1], None, "s"), rows[7]], SCHEMA)
    got = {r.vec_id: r for r in near_duplicate_embeddings(df).collect()}
    V = np.array([r[1] for r in rows], np.float32).astype(float)
    V /= np.linalg.norm(V, axis=1, keepdims=True)
    L = np.array([r[2] for r in rows])
    near = (V @ V.T >= 0.98) & (L[:, None] == L[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(260)
    for _ in range(20):
        root = np.minimum(root, np.where(near, root[None, :], 999).min(1))
    for i in range(260):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), root[i], root[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905, 906, 950))
    assert got[None].component_id is None
    assert near_duplicate_embeddings(df.limit(0)).collect() == []
