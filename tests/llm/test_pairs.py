"""Line dedup, the Jaccard join and mixing against brute force, with odd rows."""

import random
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from quire.llm import ngram_jaccard
from quire.llm.line_dedup import dedup_lines
from quire.llm.mixing import mix_sources
from quire.llm.ngram_jaccard import ngram_jaccard_join

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, source string, n_lines int, token string"


def texts(seed=1):
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(60)] for _ in range(6)]
    out = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 1, 2, 4):
            c = list(b)
            for _ in range(edits):
                c[r.randrange(60)] = r.choice(WORDS)
            out.append("  ".join(c).upper() if edits == 2 else " ".join(c))
    return [*out, out[0], out[1], None, "", " \n ", "One two", "one  TWO", "x", " ".join(["a"] * 300)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 0, "clash") for i, t in rows], SCHEMA)


def brute_components(rows, k, num, den):
    sets = defaultdict(list)
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b for x in sets[a] for y in sets[b] if x and y and den * len(x & y) >= num * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return sets, root


def test_jaccard_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [(rows[3][0], rows[3][1]), (None, rows[0][1]), (999, rows[7][1])]
    got = ngram_jaccard_join(docs(spark, rows), k=4, num=85, den=100).collect()
    sets, root = brute_components(rows, 4, 85, 100)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
            continue
        assert r.component_id == root[r.doc_id]
        assert r.n_shingles in {len(x) for x in sets[r.doc_id]}
    assert sum(r.component_id != r.doc_id for r in got) > 8


def test_postings_know_what_is_left_of_their_set():
    """A pair meets at its first shared token only if what is left of both sets from there on can reach the threshold."""
    lists = pa.array([[7, 8, 9], [], [8, 5]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([20, 4, 10]), pa.array([1, 2, 3]), pa.array([[0]] * 3), lists], names=["id", "n", "comp", "parity", "p0"])
    bits = np.zeros((1 << 17) // 8, np.uint8)
    cells = ngram_jaccard._cells(np.array([8, 9]), 17)
    np.bitwise_or.at(bits, cells >> np.uint64(3), np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8))
    for whole in (batch, pa.concat_batches([batch, batch]).slice(3)):
        got = pa.Table.from_batches(ngram_jaccard._hits(SimpleNamespace(value=bits))([whole])).to_pydict()
        assert list(zip(got["id"], got["token"], got["rest"])) == [(1, 8, 19), (1, 9, 18), (3, 8, 10)]


def test_jaccard_of_nothing(spark):
    assert ngram_jaccard_join(docs(spark, [])).collect() == []
    assert sorted(r.component_id for r in ngram_jaccard_join(docs(spark, [(5, None), (6, "")])).collect()) == [5, 6]


def brute_lines(rows, least):
    """Deletes a line if a run of lines around it with enough words stands earlier."""
    body = {i: [(p, x.strip(" \t\n\r\v\f")) for p, x in enumerate(t.split("\n")) if x.split()] for i, t in rows if t is not None}
    first, spans = {}, []
    for i in sorted(body):
        ls = body[i]
        for a in range(len(ls)):
            words = 0
            for b in range(a, len(ls)):
                words += len(ls[b][1].split())
                if words >= least:
                    run = tuple(x for _, x in ls[a : b + 1])
                    first.setdefault(run, (i, a))
                    spans.append((i, a, b, run))
    gone = defaultdict(set)
    for i, a, b, run in spans:
        if (i, a) > first[run]:
            gone[i] |= set(range(body[i][a][0], body[i][b][0] + 1))
    return gone


def test_lines_match_brute_force(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice(WORDS) for _ in range(r.choice([1, 2, 3, 6, 12]))) for _ in range(12)]
    rows = [(i, "\n".join(r.choice(["", "  "]) + r.choice(pool) if r.random() < 0.8 else "" for _ in range(r.randint(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "a b c d e f g h i j\n" * 30)]
    got = {x.doc_id: x for x in dedup_lines(docs(spark, rows), min_words=10).collect()}
    gone = brute_lines(rows, 10)
    for i, t in rows:
        if t is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        lines = t.split("\n")
        assert got[i].text == "\n".join(x for p, x in enumerate(lines) if p not in gone[i]), i
        assert (got[i].n_lines, got[i].n_removed) == (len(lines), len(gone[i]))
        assert got[i].token == "clash"
    assert sum(map(len, gone.values())) > 20


def test_lines_of_repeated_rows_and_nothing(spark):
    line = "one two three four five six seven eight nine ten eleven"
    got = dedup_lines(docs(spark, [(1, line), (1, line), (2, line), (None, line)]), min_words=5).collect()
    assert sorted((x.doc_id or -1, x.n_removed) for x in got) == [(-1, 0), (1, 1), (1, 1), (2, 1)]
    assert dedup_lines(docs(spark, [])).collect() == []


def test_mix_targets_and_limits(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 20 + ["c"] * 60 + [None] * 30)] + [(1000, None, "a"), (None, "x y", "b"), (7, "x y", "c")]
    df = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, target int, taken string")
    got = mix_sources(df).collect()
    again = mix_sources(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    total = sum(x.size for x in got)
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for x in got:
        assert x.size == 0 or (x.taken % x.size == 0 and 0 <= x.taken <= 3 * x.size)
        by[x.source_size][0] += x.size
        by[x.source_size][1] += x.taken
        by[x.source_size][2] = x.target
    assert abs(sum(v[2] for v in by.values()) - total) < 1e-6
    for size, (words, taken, target, _) in by.items():
        assert size == words and target <= 3 * size + 1e-9 and abs(taken - target) <= 80
    assert sum(v[1] for v in by.values()) <= total


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(x.size, x.taken) for x in mix_sources(blank).collect()] == [(0, 0), (0, 0)]
