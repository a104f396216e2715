"""The stages over a small corpus, each against what it must do."""

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    path = tmp_path_factory.mktemp("tables")
    word = lambda: "".join(r.choice(["an", "re", "to", "li", "ou", "er", "ka", "do"]) for _ in range(r.randint(1, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    rows = [(i, text(r.randint(2, 5)), f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "s0") for i in range(5)]
    rows += [(300 + i, " ".join(w if k % 40 else word() for k, w in enumerate(rows[i + 10][1].split(" "), 1)), None) for i in range(5)]
    toxic = ["idiot", "worthless", "pathetic"]
    rows += [(400 + i, text(1) + " " + " ".join(r.choice(toxic) for _ in range(3)) + "\n" + text(2), "s1") for i in range(60)]
    rows += [(600, None, "s1"), (601, "", None)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(400 <= i < 460)) for i, *_ in rows if i < 100 or i >= 400], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_pipeline(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    ids = {i for i, *_ in rows}
    assert len(ids - set(seen[0]) - set(range(400, 460))) <= 3 and len(set(seen[0]) & set(range(400, 460))) <= 3
    assert not set(seen[1]) & set(range(200, 205))
    assert set(seen[1]) >= set(seen[0]) - set(range(200, 205)) - set(range(300, 305))
    assert set(seen[2]) <= set(seen[1]) and len(seen[2]) >= len(seen[1]) - 6
    out = corpus_pipeline.run(spark, path).collect()
    assert out and {r.sample for r in out} == {1, 2} and {r.doc_id for r in out} <= set(seen[3])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, predicted string, taken string, component_id string, _keep string, n_lines string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, null and empty texts, columns that clash with those of the operators."""
    r = random.Random(9)
    text = lambda n=30: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(i, text(), "s") for i in range(40)] + [(50 + i, text() + " idiot scum worthless idiot scum pathetic", "t") for i in range(40)]
    rows += [(None, text(), "s"), (None, text(), None), (None, text() + " idiot scum worthless idiot scum pathetic", "s"), (3, text(), "s"), (4, "idiot scum worthless idiot scum pathetic " * 3, "s")]
    rows += [(200, None, "s"), (201, "", "t"), (202, rows[0][1], "s"), (203, rows[1][1], None), (203, rows[1][1], None)]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, int(50 <= i < 90)) for i, *_ in rows[:80]], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), [(i, t, "en", s, len(t or ""), "a", "b", "c", "d", "e") for i, t, s in rows]


def counted(rows):
    out = {}
    for r in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + 1
    return out


def test_toxicity_stage_judges_rows(spark, odd):
    path, rows = odd
    got = counted(corpus_pipeline.toxicity(spark, spark.createDataFrame(rows, COLUMNS), path).collect())
    want = counted(r for r in rows if "scum" not in (r[1] or ""))
    assert got == want


def test_line_stage_keeps_rows(spark, odd):
    path, rows = odd
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, COLUMNS), path).collect()
    kept = counted((r.doc_id, r.text, r.source, r.predicted, r._keep, r.n_lines) for r in got)
    first, want = {}, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = first.setdefault(r[1], (r[0], r[1]))
        if r[1] is None or len(r[1].split()) < 10 or own == (r[0], r[1]):
            want.append((r[0], r[1], r[3], "a", "d", "e"))
    assert kept == counted(want)


def test_jaccard_stage_keeps_one_of_each_group(spark, odd):
    path, rows = odd
    got = counted(corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), path).collect())
    assert got == counted(r for r in rows if r[0] not in (202, 203))


def test_mixing_stage_repeats_rows(spark, odd):
    from quire.llm.mixing import mix_sources

    path, rows = odd
    docs = spark.createDataFrame(rows, COLUMNS)
    got = counted(corpus_pipeline.mixing(spark, docs, path).collect())
    assert set(got) <= set(map(tuple, rows))
    words = sum(len((r[1] or "").split()) * n for r, n in got.items())
    mixed = mix_sources(docs).collect()
    assert words == sum(x.taken for x in mixed)
    taken = {}
    for x in mixed:
        if x.size:
            taken[x.doc_id] = taken.get(x.doc_id, 0) + x.taken // x.size
    by_id = {}
    for r, n in got.items():
        by_id[r[0]] = by_id.get(r[0], 0) + n
    assert by_id == {k: v for k, v in taken.items() if v}
    assert all(n <= 6 for n in got.values()) and None in by_id


def test_segmentation_stage_gives_repeats_their_own(spark, odd):
    path, rows = odd
    got = corpus_pipeline.segmentation(spark, spark.createDataFrame([rows[0]] * 3 + [rows[1]], COLUMNS).coalesce(1), path).collect()
    assert len([r for r in got if r.doc_id == 0]) == 6 and len({tuple(r.ids) for r in got if r.doc_id == 0 and r.sample == 1}) == 3


def test_stages_on_nothing(spark, odd):
    path, rows = odd
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).collect() == []
