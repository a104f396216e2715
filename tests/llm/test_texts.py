"""Language, toxicity, personal data, segmentations and chat formatting."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from quire.llm import pii, toxicity
from quire.llm.language_id import identify_languages
from quire.llm.preference import conversations_as_rows, format_preferences, pair_conversations
from quire.llm.segmentation import MODEL, Batch, decode_pieces, load, sample_segmentations
from quire.llm.toxicity import sampled, score_toxicity, subwords, train, words_of
from quire.llm.wordhash import mix

FRENCH, GERMAN = "le la les une que des tion ment eau aux ré pour dans".split(), "der die das und schung keit lich ein ge ver für nicht".split()


def sentences(words, n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(words) + r.choice(["", r.choice(words)]) for _ in range(r.randint(8, 30))) for _ in range(n)]


def test_language(spark):
    rows = [(i, t, "fr") for i, t in enumerate(sentences(FRENCH, 60, 1))] + [(100 + i, t, "de") for i, t in enumerate(sentences(GERMAN, 60, 2))]
    rows += [(300, None, "fr"), (301, "12 - !!", "de"), (302, "", None), (None, "le la les", None), (0, rows[0][1], "fr"), (303, "le la " * 50_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = identify_languages(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("fr" if i < 100 else "de") for i in by if i is not None and i < 300)
    assert [by[i].lang_pred for i in (300, 301, 302, None, 303)] == ["und", "und", "und", "fr", "fr"]
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert identify_languages(df.limit(0)).collect() == []
    untaught = df.withColumn("lang", df.lang.substr(9, 9)).filter("lang is null or doc_id = 300")
    assert {r.lang_pred for r in identify_languages(untaught).collect()} == {"und"}


def test_language_does_not_learn_from_held_out_rows(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "le la les une", "xx") for i in held] + [(1000 + i, "der die das und", "de") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert "xx" not in {r.lang_pred for r in identify_languages(df).collect()}


def test_toxicity(spark):
    r = random.Random(3)
    clean = sentences(FRENCH + GERMAN, 160, 5)
    toxic = [" ".join([*t.split()[:12], r.choice(["idiot", "worthless", "pathetic"]), *t.split()[12:]]) for t in sentences(FRENCH + GERMAN, 160, 6)]
    rows = [(i, t) for i, t in enumerate(clean + toxic)]
    extra = [(900, " ".join(clean[0].split()[:8]) + " Idiiot! worthles " + " ".join(clean[1].split()[:8])), (901, "patthetic worthles"), (902, None), (903, ""), (None, clean[2]), (904, " ".join(clean * 10) + " worthless idiot pathetic")]
    df = spark.createDataFrame([(*x, "t") for x in rows + extra], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i >= 160)) for i, _ in rows] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in score_toxicity(df, labels).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [x for i, x in got.items() if x.held_out and i is not None and i < 320]
    assert np.mean([x.predicted == int(x.doc_id >= 160) for x in held]) > 0.9
    assert got[900].predicted == got[901].predicted == got[904].predicted == 1 and got[902].predicted == got[903].predicted == 0
    assert score_toxicity(df.limit(0), labels).collect() == []
    assert {x.predicted for x in score_toxicity(df, labels.limit(0)).collect()} == {0}


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """Not in the driver, whose memory would grow by the sample and by what training holds."""
    driver = os.getpid()
    monkeypatch.setattr(toxicity, "train", lambda texts, ys: (np.zeros(toxicity.BUCKETS, np.float32), 1.0 if os.getpid() != driver and sorted(ys) == [0, 0, 1] and len(texts) == 3 else -1.0))
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "e f"), (4, None)], "doc_id long, text string")
    ids = [i for i in range(1, 4) if zlib.crc32(str(i).encode()) % 5]
    assert len(ids) == 3
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}



def test_training_is_repeatable():
    a, b = (train(["x good one", "bad idiot two"] * 8, [0, 1] * 8, epochs=2) for _ in range(2))
    assert a[1] == b[1] and (a[0] == b[0]).all()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for j, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), j, m.end(), k))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_personal_data(spark):
    r = random.Random(8)
    pieces = ["a@b.c_d@e.f", "x@y", "é1.2.3.4", "1.2.3.256", "000255.1.1.01.9", "4111 1111-1111 1111", "4111111111111111", "4111111111111112", "12 4111111111111111", "+1 (555) 555-1234", "+12", "+123456789", "..@", "ñ", "a.b@c-d.e.", "9" * 30, "- -", "+", "1-2-3"]
    rows = [(i, "".join(r.choice(pieces) + r.choice(["", " ", "\n", ","]) for _ in range(r.randint(0, 8)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "7 " * 20_000), (503, "a" * 60_000 + "@" + "b" * 50), (None, "q@w.e"), (504, "write to jan.doe (at) mail (dot) example.com now"), (505, "we look at these. Then at last."), (1, rows[1][1])]
    got = pii.find_pii(spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, t string")).collect()
    want = {i: brute_spans(t) for i, t in rows}
    assert len(got) == len(rows)
    for x in got:
        base = want[x.doc_id]
        assert x.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), rows
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in pii.KINDS)
        assert set(base) <= set(x.spans.split(",")) | {""}
    by = {x.doc_id: x for x in got}
    assert "email:9:44" in by[504].spans and by[505].spans == ""


def test_segmentations_round_trip(spark):
    texts = ["Hello  world\nagain ", " lead", "", None, "naïve ﬁ Ａ 日本 x\ty", "tick", "a" * 3000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "tick", "z"), (5, "tick", "z")], "doc_id long, text string, ids string")
    enc = sample_segmentations(df, k=3)
    got = enc.collect()
    for x in decode_pieces(enc).collect():
        assert x.text == ((texts[x.doc_id] if x.doc_id is not None else "tick") or "")
    seen = {}
    for x in got:
        seen.setdefault(x.doc_id, []).append(tuple(x.ids))
        assert 0 <= x.inclusion <= 1
    assert len(set(seen[0])) == 3 and len(seen[2]) == len(seen[3]) == 1 and len(seen[5]) == 6 and len(set(seen[5])) == 3
    assert sorted(map(str, got)) == sorted(map(str, sample_segmentations(df.repartition(3), k=3).collect()))
    assert sample_segmentations(df.limit(0)).collect() == []


def all_paths(vocabulary, text):
    """Every segmentation of a text with its probability, by brute force."""
    batch = Batch(vocabulary, [text], np.array([1], np.uint64))
    lattice, n, out = batch.lattice, len(batch.chars), []

    def go(at, edges, lp):
        if at == n:
            out.append((tuple(edges), lp))
            return
        place = batch.place(at)
        for e in range(lattice.ptr[place], lattice.ptr[place + 1]):
            go(at + int(lattice.size[e]), [*edges, int(e)], lp + float(lattice.logc[e]))

    go(0, [], 0.0)
    return out


def test_segmentations_follow_the_lattice():
    vocabulary = load(MODEL)
    paths = all_paths(vocabulary, "tint")
    assert math.isclose(sum(math.exp(lp) for _, lp in paths), 1.0, rel_tol=1e-9)
    n, first, second = 4000, {}, {}
    batch = Batch(vocabulary, ["tint"] * n, mix(np.arange(n).astype(np.uint64)))
    for found in batch.sample(2):
        keys = [tuple(e[e >= 0].tolist()) for e, *_ in found]
        assert len(set(keys)) == 2
        first[keys[0]] = first.get(keys[0], 0) + 1
        second[keys[1]] = second.get(keys[1], 0) + 1
        assert found[0][2] >= found[1][2]
    p = {k: math.exp(lp) for k, lp in paths}
    for k, v in p.items():
        assert abs(first.get(k, 0) / n - v) < 0.03
        # The second path: what is left after the first, renormalised.
        want = sum(q * v / (1 - q) for j, q in p.items() if j != k)
        assert abs(second.get(k, 0) / n - want) < 0.035
    few = Batch(vocabulary, ["tint"], np.array([9], np.uint64)).sample(len(paths) + 5)[0]
    assert len(few) == len(paths)
    assert {tuple(e[e >= 0].tolist()) for e, *_ in few} == set(p)


@pytest.fixture
def conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello there"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello there"), (2, 2, "user", "more"), (2, 3, "assistant", "no, never"),
        (3, 0, "user", "hi"), (4, 0, None, "x <|end|> y"), (4, 1, "assistant", None), (4, 1, "assistant", None), (None, 0, "user", "lost"), (5, None, "user", ""), (600, 0, "user", "hi"),
    ]
    return spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, prompt string")


def test_preferences(conversations):
    got = {r.chosen_id: r for r in format_preferences(pair_conversations(conversations_as_rows(conversations))).collect()}
    assert sorted(got) == [2, 3, 4, 5, 600]
    r = got[2]
    assert r.rejected_id == 1 and r.n_shared == 3
    assert r.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello there<|end|>\n<|user|>\nmore<|end|>\n"
    a, b = map(int, r.chosen_mask.split("-"))
    assert r.chosen[a:b] == "no, never<|end|>" and r.rejected == "<|assistant|>\nyes<|end|>\n"
    assert got[3].rejected is None and got[3].prompt == "<|user|>\nhi<|end|>\n" and got[3].chosen == ""
    assert "x < |end|> y<|end|>" in got[4].prompt and got[4].chosen == "<|assistant|>\n<|end|>\n"
    assert format_preferences(pair_conversations(conversations_as_rows(conversations.limit(0)))).collect() == []


def test_preferences_pair_over_the_whole_table(spark, tmp_path):
    from quire.llm.queries import op6_preference

    r = random.Random(5)
    said = lambda: r.choice(["yes", "no", "well, maybe", ""])
    talks = {i: [("user", "hi")] + [x for _ in range(r.randint(0, 3)) for x in (("assistant", said()), ("user", said()))] for i in [3, 255, 256, 600, 601, 5000, *range(10_000, 10_060)]}
    talks |= {700: [("user", "alone"), ("assistant", "x")], 701: [("user", "another"), ("assistant", "y")], 702: [("user", "third")]}
    rows = [(i, t, *x) for i, talk in talks.items() for t, x in enumerate(talk)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op6_preference(spark, str(tmp_path)).collect()
    key = lambda i: ([hashlib.md5(f"{role}\x1f{text}".encode()).hexdigest() for role, text in talks[i]], i)
    order = sorted(talks, key=key)
    spoken = lambda i: sum(len(t) for role, t in talks[i] if role == "assistant")
    want = {tuple(sorted(order[k : k + 2], key=lambda i: (-spoken(i), i))) for k in range(0, len(order), 2)}
    assert len(order) % 2 and {(x.chosen_id,) if x.rejected_id is None else (x.chosen_id, x.rejected_id) for x in got} == want
    for x in got:
        if x.rejected_id is None:
            continue
        a, b = talks[x.chosen_id], talks[x.rejected_id]
        n = next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
        assert x.n_shared == n
        for turns, text, mask in ((a[n:], x.chosen, x.chosen_mask), (b[n:], x.rejected, x.rejected_mask)):
            assert text == "".join(f"<|{role}|>\n{t}<|end|>\n" for role, t in turns)
            assert [text[int(s.split("-")[0]) : int(s.split("-")[1])] for s in mask.split(",") if s] == [t + "<|end|>" for role, t in turns if role == "assistant"]
    assert sum(x.n_shared > 0 for x in got) >= 31


def test_a_long_text_pushes_no_other_out():
    rows = [("bad " * 5000, 1), ("good " * 5000, 0), *((f"idiot number{i}", 1) for i in range(20)), *((f"nice number{i}", 0) for i in range(20))]
    texts, ys = sampled(rows, 50, 1000)
    assert ys == [y for _, y in rows] and [" ".join(t) for t in texts[2:]] == [t for t, _ in rows[2:]]
    assert 900 < len(texts[0]) <= 960 and sum(len(t) for t, y in zip(texts, ys, strict=True) if y == 1) <= 1000
    assert len(sampled(rows, 5, 1000)[0]) == 10 and sampled([], 5, 10) == ([], [])
    assert sampled(rows, 50, 1000) == (texts, ys)


def test_long_words_are_read_whole():
    grams = lambda w: {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    token = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(301))
    pieces = words_of(f"one {token} two")
    assert pieces[0] == "one" and pieces[-1] == "two" and len(pieces) > 4
    assert set().union(*(grams(p[1:]) for p in pieces[1:-1])) == grams(f"<{token}>")
    joined = "-".join(["fine"] * 40 + ["idiot"] + ["fine"] * 40)
    weights, bias = train(["a fine day", "an idiot day"] * 8, [0, 1] * 8)
    score = lambda t: max(np.mean([weights[b] for b in subwords(w)]) for w in words_of(t))
    assert score(joined) > score(joined.replace("idiot", "fine"))
