"""The engine's scenarios on page-record fixtures."""

import time

import pytest
from pyspark.sql import functions as F
from quire.config import Config, from_toml, from_toml_safe
from quire.functions import naming as N
from quire.functions import signals as S
from quire.functions import text as T
from quire.operators import alignment, exact, fingerprint, keydocs, packing, review
from quire.operators.compare import PAGE, compare_pages
from quire.plans import engine
from quire.schema import OCCURRENCES, RAW_PAGES, conform
from quire.sources import decoders, inventory, sinks

NO_IMAGES, NO_FIELDS, NO_NOTES = [], [], []


def pages_of(spark, docs, package="P"):
    """docs: {id: [page text or a dict of columns]}."""
    rows = []
    for d, ps in docs.items():
        for i, p in enumerate(ps):
            p = {"raw_text": p} if not isinstance(p, dict) else p
            rows.append((package, d, i, p.get("raw_text"), 612.0, 792.0, 0, p.get("form_fields", []), p.get("annotations", []), p.get("images", [])))
    return spark.createDataFrame(rows, RAW_PAGES)


def occ_of(spark, docs, package="P"):
    import hashlib

    rows = [(package, d, i, d, hashlib.sha256(repr(ps).encode()).hexdigest(), 100, "converted", False, False, len(ps), 100) for i, (d, ps) in enumerate(docs.items(), 1)]
    df = spark.createDataFrame(rows, "package_id string, document_id string, traversal_index int, original_filename string, original_sha256 string, original_size_bytes long, status string, is_ignored_artifact boolean, is_portfolio_container boolean, converted_page_count int, converted_size_bytes long")
    return conform(df, OCCURRENCES)


def words(seed, n=40):
    import random

    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta omega kappa sigma zeta iota rho".split()) + str(r.randint(0, 99)) for _ in range(n))


def test_packing_golden(spark):
    rows = [("P", f"D{i}", i, n, 0) for i, n in enumerate([125, 98, 162, 41])] + [("Q", "A", 1, 500, 0), ("Q", "B", 2, 10, 0), ("Q", "C", 3, 395, 0)]
    df = spark.createDataFrame(rows, "package_id string, document_id string, traversal_index int, converted_page_count int, converted_size_bytes long")
    members = packing.plan_parts(df, 400, 10**9)
    got = {(r.package_id, r.part): r for r in packing.parts(members, 400, 10**9).collect()}
    assert [(got["P", k].page_count, got["P", k].n_documents) for k in (1, 2)] == [(385, 3), (41, 1)]
    assert got["P", 1].close_reasons == ["page_maximum"] and got["P", 2].close_reasons == ["end_of_package"]
    assert got["Q", 1].is_oversized and got["Q", 1].close_reasons == ["oversized_document", "page_maximum"] and got["Q", 2].document_ids == ["B"]


def test_packing_of_a_large_package_takes_time_in_proportion(spark):
    n = 100_000
    docs = spark.range(n).select(F.lit("P").alias("package_id"), F.col("id").cast("string").alias("document_id"), F.col("id").alias("traversal_index"), F.lit(3).alias("converted_page_count"), F.lit(1).alias("converted_size_bytes"))
    began = time.monotonic()
    got = packing.plan_parts(docs, 100, 10**9).groupBy("part").agg(F.count("*").alias("n"), F.min("traversal_index").alias("i")).collect()
    assert time.monotonic() - began < 30
    assert {(r.part, r.n, r.i) for r in got} == {(k + 1, min(33, n - 33 * k), 33 * k) for k in range(-(-n // 33))}


def test_run_with_copies_versions_and_containment(spark):
    a, b, c, d = (words(i) for i in range(4))
    near = a.split(" ")
    near[5] = near[20] = near[30] = "changed"
    docs = {
        "DOC-000001": [a, b, c], "DOC-000002": [a, b], "DOC-000003": [d], "DOC-000004": [d, ""], "DOC-000005": [" ".join(near)], "DOC-000006": [a], "DOC-000007": [d.upper().replace(" ", "  ")],
    }
    run = engine.build(occ_of(spark, docs), pages_of(spark, docs), Config(max_pages_per_part=4))
    got = {r.document_id: r for r in run.occurrences.collect()}
    assert got["DOC-000002"].is_contained and got["DOC-000002"].contained_in == "DOC-000001"
    assert {k for k, r in got.items() if r.is_content_duplicate} == {"DOC-000004", "DOC-000007"}
    assert got["DOC-000001"].included_in_final and got["DOC-000003"].included_in_final
    assert all(got[k].needs_review and got[k].included_in_final for k in ("DOC-000005", "DOC-000006"))
    checks = run.checks.collect()
    assert len(checks) == 27 and all(r.passed for r in checks), [r for r in checks if not r.passed]
    assert run.success().first().success


def test_vetoes(spark):
    base = "On 2026-01-15 John Smith paid $1,234.50 for the house and the garden with all that stands there"
    variants = [base, base.replace("01-15", "01-16"), base.replace("John", "Jane"), base.replace("1,234", "1,235"), {"raw_text": base, "form_fields": [("x", "/Tx", "1")]}, {"raw_text": base, "form_fields": [("s", "/Sig", "v")]}]
    fp = fingerprint.page_fingerprints(pages_of(spark, {f"D{i}": [v] for i, v in enumerate(variants)}))
    one = fp.filter("document_id = 'D0'").select(F.struct(*PAGE).alias("a"))
    got = compare_pages(one.crossJoin(fp.select("document_id", F.struct(*PAGE).alias("b")))).select("document_id", "veto", "exact").collect()
    assert {r.document_id: r.veto for r in got} == {"D0": None, "D1": "dates", "D2": "name_hints", "D3": "dollar_amounts", "D4": "form_values", "D5": "signature_field"}
    assert {r.document_id for r in got if r.exact} == {"D0"}


def test_frequent_words_are_no_anchors(spark):
    import random

    r = random.Random(1)
    t = [r.choice([f"v{i}" for i in range(40)]) for _ in range(300)]
    u = [*t[:150], "other", *t[151:]]
    got = spark.createDataFrame([(" ".join(t), " ".join(u))], "a string, b string").select(T.word_ratio("a", "b").alias("r")).first().r
    assert got < 0.9


def test_bounds_hold(spark):
    pairs = [(words(i), words(i + k)) for i in range(6) for k in (0, 1)] + [("", ""), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    df = df.select(T.word_ratio("a", "b").alias("r"), T.bag_bound(T.bag(split("a")), T.bag(split("b"))).alias("x"), T.char_ratio("a", "b").alias("q"), T.counts_bound(T.char_counts(F.col("a")), T.char_counts(F.col("b"))).alias("y"))
    assert all(r.x >= r.r - 1e-9 and r.y >= r.q - 1e-9 for r in df.collect())


def test_names(spark):
    df = spark.createDataFrame([("file10.txt",), ("file2.txt",), ("File1.txt",)], "n string")
    assert [r.n for r in df.orderBy(N.natural_key(F.col("n"))).collect()] == ["File1.txt", "file2.txt", "file10.txt"]
    paths = {"a/./b": "a/b", "/etc/x": "BLOCKED_UNSAFE_PATH/x", "c:\\x\\y": "BLOCKED_UNSAFE_PATH/y", "a/../b": "BLOCKED_UNSAFE_PATH/b", "": "BLOCKED_UNSAFE_PATH/unnamed_entry"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", N.safe_path(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in got} == paths
    last, first, loan = N.identity(F.col("f"))
    got = spark.createDataFrame([("True, Michael, 12",), ("Solo",), ("A,B",)], "f string").select(last.alias("l"), first.alias("f"), loan.alias("n")).collect()
    assert [tuple(r) for r in got] == [("True", "Michael", "12"), ("Solo", "", ""), ("A", "B", "")]


def test_key_documents(spark):
    docs = {
        "D1": ["Closing Disclosure page 1 of 5 Loan Terms Projected Payments", "page 2 of 5", "Closing Disclosure page 3 of 5"], "D2": ["Loan Estimate page 1 of 3 Save this Loan Estimate to compare with your Closing Disclosure"],
        "D3": ["please provide a driver's license"], "D4": [{"raw_text": "Driver License DOB Class", "images": [("s", 1, (0.0, 0.0, 0.0), False, 9, 9)]}], "D5": ["Notice of Denial"],
    }
    got = {(r.document_id, r.category): r for r in keydocs.find_key_documents(fingerprint.page_fingerprints(pages_of(spark, docs))).collect()}
    assert set(got) == {("D1", "closing_disclosure"), ("D2", "loan_estimate"), ("D4", "government_id"), ("D5", "non_proceeding")}
    cd = got["D1", "closing_disclosure"]
    assert (cd.confidence_band, cd.first_page, cd.last_page) == ("Confirmed", 1, 3) and got["D4", "government_id"].subtype == "Drivers License Front"


def test_comparison_of_packages(spark):
    a, b, c, d = (words(i) for i in range(10, 14))
    fp = lambda docs: fingerprint.page_fingerprints(pages_of(spark, docs)).withColumn("file_order", F.col("document_id"))
    got = alignment.compare_packages(fp({"X": [a, b, c]}), fp({"X": [a, c, d], "Y": [""]})).collect()
    assert sorted((r.category, r.old_page, r.new_page) for r in got if r.category != "Extra Blank, Cover, Index, or Report Page") == [("Exact Match", 0, 0), ("Exact Match", 2, 1), ("Only in New", None, 2), ("Possible Missing Document", 1, None)]


def test_decisions_are_write_once(spark):
    import datetime

    matches = spark.createDataFrame([("P", "UM-0001", ["A", "B"])], "package_id string, match_id string, excludable array<string>")
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    made = spark.createDataFrame([("P", "UM-0001", "excluded", "B", at(1), None), ("P", "UM-0001", "keep_both", None, at(2), None), ("P", "UM-0009", "excluded", "B", at(1), None)], "package_id string, match_id string, decision string, document_id string, decided_at timestamp, reason string")
    got = review.valid_decisions(made, matches)
    assert [(r.match_id, r.problem) for r in got.orderBy("match_id", "decided_at").collect()] == [("UM-0001", None), ("UM-0001", "already decided"), ("UM-0009", "no such match")]


def test_null_decision_does_not_restore(spark):
    df = spark.createDataFrame([(False, False, True, False, False, None, False, False), (False, False, True, False, False, "restored", False, False), (False, False, True, False, True, None, False, False)], "is_ignored_artifact boolean, is_duplicate boolean, is_content_duplicate boolean, is_contained boolean, needs_review boolean, duplicate_review_decision string, is_portfolio_container boolean, manually_excluded boolean")
    assert [r[0] for r in df.select(exact.included_in_final()).collect()] == [False, True, True]


def test_inventory_and_decoders(spark, tmp_path):
    import io
    import zipfile
    from email.message import EmailMessage

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    folder = tmp_path / "in" / "loan"
    folder.mkdir(parents=True)
    with zipfile.ZipFile(folder / "a2.zip", "w") as z:
        z.writestr("one.txt", "line\n" * 3)
        z.writestr("in.zip", inner.getvalue())
        z.writestr("__MACOSX/x", "x")
        z.writestr("../evil.txt", "e")
    mail = EmailMessage()
    mail["Subject"] = "S"
    mail.set_content("body")
    mail.add_attachment(b"att", maintype="application", subtype="octet-stream", filename="t.txt")
    (folder / "a10.eml").write_bytes(bytes(mail))
    (folder / "b.xyz").write_bytes(b"?")
    (folder / "c.html").write_text("<html><head><title>no</title></head><body><p>Hello <b>you</b></p><script>x</script><td>1</td></body></html>")
    occ = inventory.scan(spark, str(tmp_path / "in")).persist()
    got = occ.orderBy("traversal_index").collect()
    assert [r.original_filename for r in got] == ["one.txt", "deep.txt", "x", "evil.txt", "a10.eml", "b.xyz", "c.html"]
    assert [r.is_ignored_artifact for r in got].count(True) == 1 and got[3].original_relative_path.startswith("BLOCKED")
    pages = decoders.decode_files(occ.filter("content is not null")).collect()
    by = {}
    for p in pages:
        by.setdefault(p.document_id, []).append(p)
    assert by[got[5].document_id][0].status == "unconverted_placeholder" and "att" in [p.raw_text for p in by[got[4].document_id]]
    assert by[got[6].document_id][0].raw_text == "Hello you\n1"


def test_small_things(spark):
    assert from_toml("[splitting]\nmax_pages_per_part = 7\n[other]\nx = 1").max_pages_per_part == 7
    assert from_toml_safe("broken = = 1")[1] is not None
    df = spark.createDataFrame([(3, 5)], "a long, b long")
    assert df.select(S.hamming(F.col("a"), F.col("b"))).first()[0] == 2
    assert sinks.next_version(spark, "file:///tmp", "no-such-folder-at-all").endswith("no-such-folder-at-all")


def test_entry_works_without_llm(spark, monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def missing(name, *a, **k):
        if name in ("corpus_pipeline",) or name.startswith("quire.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", missing)
    sys.modules.pop("__spark_entry__", None)
    module = importlib.import_module("__spark_entry__")
    assert "pipeline" not in module.queries() and set(module.oracle_sql()) <= set(module.queries())
    sys.modules.pop("__spark_entry__", None)


def test_streaming_exact(spark, tmp_path):
    from quire.streaming.exact import first_of_each_hash

    spark.createDataFrame([("P", "a", 1), ("P", "a", 2), ("Q", "a", 3)], "package_id string, text string, n int").withColumn("arrived_at", F.current_timestamp()).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "s")).schema).parquet(str(tmp_path / "s"))
    q = first_of_each_hash(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2


def test_comparison_covers_every_document(spark, tmp_path):
    from quire import catalogue

    rows = [(i, "\n".join(words(100 * i + k, 20) for k in range(3)), "en", "s") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.compare_packages(spark, str(tmp_path)).collect()
    assert {r.package_id for r in got} == {"en-0", "en-1", "en-2"}
    # Every page of the old side has one finding: 40, 40 and 20 documents of three pages.
    for package, n in (("en-0", 120), ("en-1", 120), ("en-2", 60)):
        assert sorted(r.old_page for r in got if r.package_id == package and r.old_page is not None) == list(range(n))
    counted = catalogue.compare_categories(spark, str(tmp_path)).agg(F.sum("n")).first()[0]
    assert counted == len(got)


def test_reports_of_the_whole_run(spark, tmp_path, monkeypatch):
    import json

    from quire import catalogue

    a, b, c, d = (words(i) for i in range(4))
    texts = ["\n".join([a, b, c]), "\n".join([a, b]), d, d.upper().replace(" ", "  "), d]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    runs = {True: catalogue._run(spark, str(tmp_path))}  # made once; a query that asks for the run of exact duplicates fails
    monkeypatch.setattr(catalogue, "_run", lambda spark, sf_dir, aware=True: runs[aware])
    ask = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    kept = {r.document_id: json.loads(r.json) for r in ask("manifest_json")}
    assert kept["DOC-000002"]["contained_in"] == "DOC-000001" and {k for k, r in kept.items() if r["included_in_final"]} == {"DOC-000001", "DOC-000003"}
    log = {(r.document_id, r.retained_id, r.method == "exact") for r in ask("content_duplicate_log")}
    assert log == {("DOC-000005", "DOC-000003", True), ("DOC-000004", "DOC-000003", False)}
    report = ask("content_processing_report")[0]
    assert (report.found, report.exact_duplicates, report.content_duplicates, report.contained, report.in_final) == (5, 1, 1, 1, 2)
    assert [r.documents for r in ask("content_final_parts")] == ["DOC-000001|DOC-000003"]


def test_long_chains_of_containers(spark):
    from quire.operators.containment import topmost

    engine.ensure_checkpoints(spark)
    df = spark.createDataFrame([(p, f"D{i}", f"D{i + 1}") for p, n in (("P", 100), ("Q", 3)) for i in range(n)], "package_id string, document_id string, container_id string")
    got = topmost(df).collect()
    assert len(got) == 103 and {(r.package_id, r.retained_id) for r in got} == {("P", "D100"), ("Q", "D3")}


@pytest.mark.parametrize("name", ["exact_dup_groups", "plan_parts", "exact_containment"])
def test_queries_run(spark, name):
    from quire import catalogue

    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").columns


def test_packages_resolve_pages_of_both_sides(spark):
    from quire.operators.alignment import page_score

    base = [" ".join(words(i).split()[:40] or [f"w{i}"]) + f" filler number {i} of a page that is long enough to be more than a cover sheet or an index page of any kind at all" for i in range(8)]
    near = base[5].replace("long enough", "long plenty")
    fp = lambda docs: fingerprint.page_fingerprints(pages_of(spark, docs)).withColumn("file_order", F.col("document_id"))
    old = {"X": [base[0], base[1], base[2], base[3], base[0]]}
    new = {"X": [base[2], base[0], base[6], near, base[7], base[7] + " tail"]}
    got = alignment.compare_packages(fp(old), fp(new)).collect()
    assert [(r.old_page if r.old_page is not None else 10**9, r.new_page or 0) for r in got] == sorted((r.old_page if r.old_page is not None else 10**9, r.new_page or 0) for r in got)
    assert sorted(int(r.finding_id[4:]) for r in got) == list(range(1, len(got) + 1))
    old_seen, new_seen = [r.old_page for r in got if r.old_page is not None], [r.new_page for r in got if r.new_page is not None]
    assert sorted(old_seen) == list(range(5)) and sorted(new_seen) == list(range(6))
    assert all(r.confidence is not None for r in got)
    by = {(r.old_page, r.new_page): r for r in got}
    lone = [r for r in got if r.old_page is None or r.new_page is None]
    assert {r.confidence for r in lone if r.category in ("Possible Missing Document", "Only in New")} <= {0.3}
    assert any(r.category == "Likely Duplicate Removed" and r.old_page in (0, 4) for r in got) or any(r.category == "Exact Match" for r in by.values())
    page = lambda t, veto="v", images="[]": alignment._Page(veto, str(hash(t)), t, images, False)
    assert page_score(page("a b"), page("a b", "w")) is None and page_score(page("a b"), page("a b")) == 1.0
    red, dark = '[{"byte_sha256":"x","perceptual_hash":0,"average_color":{"r":255.0,"g":0.0,"b":0.0}}]', '[{"byte_sha256":"y","perceptual_hash":15,"average_color":{"r":255.0,"g":0.0,"b":0.0}}]'
    assert page_score(page("a b", images=red), page("a b", images=dark)) == 1.0 - 4 / 64


def test_replaced_pages_of_low_likeness_are_meaningful(spark):
    fp = lambda docs: fingerprint.page_fingerprints(pages_of(spark, docs)).withColumn("file_order", F.col("document_id"))
    a, b, c = "one two three four " * 20, "five six seven eight " * 20, "nine ten eleven twelve " * 20
    got = alignment.compare_packages(fp({"X": [a, b]}), fp({"X": [a, c]})).collect()
    assert [(r.category, r.old_page, r.new_page, r.confidence) for r in got] == [("Exact Match", 0, 0, 1.0), ("Meaningful Difference", 1, 1, 0.0)]


def test_form_fields_differ_by_type_and_by_no_value(spark):
    from quire.operators.compare import compare_pages, page_structs

    def first(field):
        pages = fingerprint.page_fingerprints(pages_of(spark, {"D": [{"raw_text": "same text", "form_fields": [field]}]})).withColumn("ord", F.lit(0))
        return pages

    def verdict(x, y):
        a, b = page_structs(first(x), "a"), page_structs(first(y), "b")
        r = compare_pages(a.join(b, ["package_id", "ord"])).first()
        return r.exact, r.veto

    assert verdict(("n", "/Tx", "v"), ("n", "/Tx", "v")) == (True, None)
    assert verdict(("n", "/Tx", "v"), ("n", "/Ch", "v")) == (False, "form_values")
    assert verdict(("n", "/Tx", None), ("n", "/Tx", "")) == (False, "form_values")


def test_blank_layout_tells_strict_from_tolerant(spark):
    from quire.operators.content import blank_layout

    docs = {"A": ["text one", "", "text two"], "B": ["text one", "", "text two"], "C": ["text one", "text two"], "D": ["", "text one", "text two"]}
    got = {r.document_id: r.blanks for r in blank_layout(fingerprint.page_fingerprints(pages_of(spark, docs))).collect()}
    assert got["A"] == got["B"] and len(set(got.values())) == 3


def test_long_chains_of_edges_are_finished(spark):
    from quire.operators.graph import components

    edges = spark.createDataFrame([("P", f"{i:04d}", f"{i + 1:04d}") for i in range(300)], "package_id string, a string, b string")
    assert {r.component for r in components(edges).collect()} == {"0000"}
