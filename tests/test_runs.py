"""Runs from files, limits, reports and what sinks add."""

import datetime
import io
import itertools
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire import __main__ as cli
from quire.config import Config
from quire.functions import naming as N
from quire.operators import containment, packing
from quire.plans import control, reports
from quire.sources import inventory, sinks, testdata


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def overlaps(docs, least):
    """Brute force: the longest common run of each candidate in each larger document, and whole containments."""
    part, whole = set(), set()
    for a, b in itertools.permutations(docs, 2):
        x, y = docs[a], docs[b]
        if len(y) <= len(x):
            continue
        best = max((k for i in range(len(x)) for j in range(len(y)) for k in range(1, min(len(x) - i, len(y) - j) + 1) if x[i : i + k] == y[j : j + k]), default=0)
        if best and best / len(x) >= least:
            part.add((a, b, best))
        at = [j for j in range(len(y) - len(x) + 1) if y[j : j + len(x)] == x]
        if at:
            whole.add((a, b, at[0], at[0] + len(x) - 1))
    return part, whole


@pytest.mark.parametrize("least", [0.4, 0.1, 1.0])
def test_overlaps_are_those_of_brute_force(spark, least):
    r = random.Random(5)
    docs = {f"D{i}": [r.choice("abc") for _ in range(r.randint(1, 14))] for i in range(40)}
    docs |= {"long": list("abcabcabbacbabcacbacbbacabcbaabc") * 2, "one": ["a"], "other": ["z"]}
    rows = [("P", d, k, p) for d, ps in docs.items() for k, p in enumerate(ps)]
    pages = spark.createDataFrame(rows, "package_id string, document_id string, ord int, page string").withColumn("text_hash", F.sha2("page", 256)).drop("page")
    sizes = pages.groupBy("package_id", "document_id").agg(F.count("*").alias("non_blank_pages"))
    part, whole = overlaps(docs, least)
    assert {(x.document_id, x.container_id, x.run) for x in containment.partial_overlap(pages, sizes, least).collect()} == part
    assert {(x.document_id, x.container_id, x.start, x.end) for x in containment.exact_containment(pages, sizes).collect()} == whole


def test_overlaps_deal_out_no_pairs_that_a_short_page_makes(spark, monkeypatch):
    """300 documents of two or three pages with one page in common: only ends of longer runs are rows, and blocks of any size give the same."""
    docs = {f"D{i:03}": ["common", f"own {i}"] + ["common", f"more {i % 40}"][: i % 3] for i in range(300)} | {"W": ["own 1", "common", "common", "own 1", "own 2", "common", "more 2"]}
    rows = [("P", d, k, p) for d, ps in docs.items() for k, p in enumerate(ps)]
    pages = spark.createDataFrame(rows, "package_id string, document_id string, ord int, page string").withColumn("text_hash", F.sha2("page", 256)).drop("page")
    ends = containment.run_ends(containment.runs(pages), 0.4)
    few = [d for d in docs if len(docs[d]) > 2]
    assert ends.filter("begins").count() < 2000 < len(few) * (len(few) - 1) // 2
    want = overlaps(docs, 0.4)[0]
    got = lambda: [(x.document_id, x.container_id, x.run) for x in containment.partial_overlap(pages, pages, 0.4).collect()]
    assert sorted(got()) == sorted(want)
    for name, small in (("BLOCK", 100), ("CANDIDATES", 30)):
        monkeypatch.setattr(containment, name, small)
    assert sorted(got()) == sorted(want)


def test_longest_runs_are_the_same_with_few_matches_at_once(monkeypatch):
    r = np.random.default_rng(3)
    size = r.integers(1, 9, 60)
    code, side = r.integers(0, 6, size.sum()), r.integers(0, 2, 60)
    docs = {i: c.tolist() for i, c in enumerate(np.split(code, np.cumsum(size)[:-1]))}
    want = {x for x in overlaps(docs, 0.0)[0] if side[x[0]] == 0 and side[x[1]] == 1}
    for most in (1, 50, 1 << 20):
        monkeypatch.setattr(containment, "MATCHES", most)
        got = [t for x in containment._longest_runs(size, code, side) for t in zip(*(v.tolist() for v in x), strict=True)]
        assert len(got) == len(want) and set(got) == want


def test_overlaps_of_the_tables_deal_out_hashes_and_no_lines(spark):
    found = containment.partial_overlap(*testdata.merged_pages(spark, "/root/testdata/sf0.001"))
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert dealt and not [x for x in dealt if re.search(r"\bline#", x)]


def test_rebuilt_parts_pop_the_last_document(spark):
    plan = [("P", d, i, 1, 1, part) for i, (d, part) in enumerate([("A", 1), ("B", 1), ("C", 1), ("D", 2), ("E", 3)])] + [("Q", "X", 1, 1, 1, 1)]
    members = spark.createDataFrame(plan, "package_id string, document_id string, traversal_index int, pages int, bytes long, part int")
    real = spark.createDataFrame([("P", "A", 6), ("P", "B", 5), ("P", "C", 5), ("P", "D", 20), ("Q", "X", 99)], "package_id string, document_id string, bytes long")
    got = {(r.package_id, r.document_id): r.part for r in packing.rebuilt(members, real, 11).collect()}
    assert got == {("P", "A"): 1, ("P", "B"): 1, ("P", "C"): 2, ("P", "D"): 3, ("P", "E"): 4, ("Q", "X"): 1}


def test_preflight_and_limits(spark, tmp_path):
    inner = zipped({"x.txt": b"x" * 100, "y.txt": b"y" * 50})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(zipped({"i.zip": inner, "z.txt": b"z" * 10, "d/": b""}))
    (tmp_path / "in" / "bad.zip").write_bytes(b"PK\x03\x04broken")
    expected = inventory.estimate(spark, str(tmp_path / "in"), "P")
    outer = (tmp_path / "in" / "a.zip").stat().st_size
    row = expected.first()
    assert (row.entries, row.bytes) == (1 + 2 + 2 + 1, outer + len(inner) + 10 + 150 + 10)
    assert inventory.preflight(expected, Config()) == (row.entries, row.bytes)
    with pytest.raises(inventory.InputTooLarge):
        inventory.preflight(expected, Config(max_entries=3))
    assert inventory.preflight(expected, Config(max_entries=3), allow_large=True)[0] == 6
    with pytest.raises(inventory.NotEnoughSpace):
        inventory.preflight(expected, Config(), free_bytes=row.bytes)
    found = inventory.scan(spark, str(tmp_path / "in"), "P")
    assert inventory.enforced(found, 10, 10**6).count() == 4
    with pytest.raises(Exception, match="larger than allowed"):
        inventory.enforced(found, 2, 10**6).collect()


def test_a_run_from_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Closing Disclosure page 1 of 5\nLoan Terms Projected Payments and more words")
    (folder / "b.txt").write_text("Closing Disclosure page 1 of 5\nLoan Terms Projected Payments and more words")
    (folder / "c.bin").write_bytes(b"\x00\x01")
    (folder / "Thumbs.db").write_bytes(b"x")
    assert cli.main(["build", str(folder), str(tmp_path / "out"), "--package", "P", "--exact-only"], spark) == 0
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    got = {r.original_filename: r for r in read("occurrences").collect()}
    assert got["b.txt"].is_duplicate and got["b.txt"].converted_page_count == got["a.txt"].converted_page_count == 1
    assert got["c.bin"].status == "unconverted_placeholder" and got["Thumbs.db"].is_ignored_artifact
    checks = read("checks").collect()
    assert len(checks) == 27 and all(r.passed and r.details == [] for r in checks)
    assert {(r.section, r.category) for r in read("key_document_report").collect()} == {("match", "closing_disclosure"), ("not_found", "closing_disclosure")}
    assert [r.target for r in read("unconverted").collect()] == ["c.bin"]
    lines = {(r.section, r.item): r.line for r in read("processing_report").collect()}
    assert lines["inventory", "found"] == "4" and lines["inventory", "exact duplicates"] == "1" and lines["final", "documents"] == "2" and lines["checks", "27 originals unmodified"] == "passed"
    with pytest.raises(Exception, match="(?i)exists"):
        cli.main(["build", str(folder), str(tmp_path / "out"), "--exact-only"], spark)
    (tmp_path / "small.toml").write_text("max_entries = 1")
    assert cli.main(["build", str(folder), str(tmp_path / "no"), "--config", str(tmp_path / "small.toml")], spark) == 2


def test_names_of_bundles_and_folders(spark):
    files = spark.createDataFrame([("P", k, n) for k, n in enumerate(["a.txt", "a (2).txt", "a.txt", "a.txt", ".x", ".x", "n", "n"])], "package_id string, at int, name string")
    assert [r.target for r in sinks.bundled(files).orderBy("at").collect()] == ["a.txt", "a (2).txt", "a (3).txt", "a (4).txt", ".x", ".x (2)", "n", "n (2)"]
    df = spark.createDataFrame([("L", "F", "scan.zip"), ("", None, "scan.zip")], "l string, f string, s string").withColumn("at", F.lit(datetime.datetime(2026, 1, 2, 3, 4, 5)))
    empty = F.lit("")
    got = df.select(N.output_folder(F.col("l"), F.col("f"), F.lit(True), empty, empty, F.col("s"), F.col("at")).alias("n")).collect()
    assert [r.n for r in got] == ["L, F, Adverse", "scan_Lender_Package_Output_20260102_030405"]


def test_logs_decisions_and_what_is_put_aside(spark, tmp_path):
    lines = spark.createDataFrame([('{"last_name": "A", "document_count": 3}',), ("{broken",), (None,), ("[1]",)], "value string")
    assert [(r.last_name, r.lender, r.document_count, r.is_adverse) for r in sinks.history_rows(lines).collect()] == [("A", "", 3, False)]
    made = spark.createDataFrame([("P", "UM-0001", "keep_both", None)], "package_id string, match_id string, decision string, document_id string")
    log = str(tmp_path / "log")
    sinks.record_decision(made, log)
    sinks.record_decision(made, log)
    assert spark.read.parquet(log).count() == 2
    for _ in range(2):
        (tmp_path / "run").mkdir()
        sinks.put_aside(spark, [str(tmp_path / "run"), str(tmp_path / "none")], str(tmp_path / "aside"), "stopped")
    assert sorted(p.name for p in (tmp_path / "aside").iterdir()) == ["run", "run, v2"]


def test_source_hash_follows_side_name_and_content(spark):
    rows = [("P", 0, "f2.pdf", 1, "aa"), ("P", 0, "f10.pdf", 2, "bb"), ("P", 1, "g.pdf", 3, "cc")]
    schema = "package_id string, side int, name string, size long, sha string"
    of = lambda r: sinks.source_hash(spark.createDataFrame(r, schema)).first().hash
    import hashlib

    want = hashlib.sha256(b"f2.pdf1\xaaf10.pdf2\xbb|side|g.pdf3\xcc|side|").hexdigest()
    assert of(rows) == of(rows[::-1]) == want and of([("P", 1 - s, n, b, h) for _, s, n, b, h in rows]) != want


def test_portfolios_and_reasons(spark):
    occ = spark.createDataFrame([("P", "A", 1, True, None), ("P", "A-PF-001", 2, False, "A"), ("P", "B", 3, True, None)], "package_id string, document_id string, traversal_index int, is_portfolio_container boolean, portfolio_parent_document_id string")
    assert {(r.parent_id, r.document_id, r.position) for r in reports.portfolio_report(occ).collect()} == {("A", "A-PF-001", 1), ("B", None, None)}
    df = spark.createDataFrame([(["page_maximum", "new"],), ([],), (None,)], "r array<string>")
    assert [r[0] for r in df.select(reports.close_text(F.col("r"))).collect()] == ["the next document would exceed the page maximum; new", "unknown", "unknown"]


def test_tagged_jobs_stop(spark):
    import threading

    timer = threading.Timer(2, lambda: control.cancel(spark, "slow"))
    timer.start()
    with pytest.raises(Exception, match="(?i)cancel"), control.cancellable(spark, "slow"):
        spark.range(4).mapInPandas(lambda it: (__import__("time").sleep(20) or f for f in it), "id long").collect()
    assert spark.range(3).count() == 3


def test_versions_and_findings_in_groups(spark):
    rows = [("P", 1, "v1", "B", True), ("P", 1, "v1", "A", False), ("P", 1, "v2", "C", True), ("Q", 1, "v1", "A", True)]
    report = spark.createDataFrame(rows, "package_id string, family int, version string, document_id string, retained boolean")
    assert {(r.package_id, r.family, r.version, tuple(r.members), r.retained) for r in reports.version_groups(report).collect()} == {("P", 1, "v1", ("A", "B"), 1), ("P", 1, "v2", ("C",), 1), ("Q", 1, "v1", ("A",), 1)}
    found = spark.createDataFrame([("P", "F1", "Only in Old", 3, None)], "package_id string, finding_id string, category string, old_page int, new_page int")
    assert reports.comparison_manifest(found).first().json == '{"package_id":"P","finding_id":"F1","category":"Only in Old","old_page":3,"new_page":null}'
