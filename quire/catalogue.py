"""All queries of the engine over the driver's tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import catalogue_sql
from quire.config import Config
from quire.functions import naming as N
from quire.functions import signals as S
from quire.functions import text as T
from quire.operators import alignment, containment, content, exact, families, fingerprint, graph, keydocs, packing
from quire.plans import engine, reports
from quire.schema import RAW_PAGES, conform
from quire.sources import decoders, inventory, sinks
from quire.sources import testdata as D

K = ["package_id", "document_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# Exact duplicates and the text layer.


@query
def exact_dup_groups(spark, sf_dir):
    keyed = D.table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("?")).alias("package_id"), "doc_id", F.sha2("text", 256).alias("sha"))
    grouped = keyed.groupBy("package_id", "sha").agg(F.min("doc_id").alias("retained_doc_id"), F.count("*").alias("n_members"))
    return grouped.filter("n_members > 1").withColumn("n_redundant", F.col("n_members") - 1)


@query
def exact_dup_flags(spark, sf_dir):
    return exact.flag_exact_duplicates(D.occurrences(spark, sf_dir)).select(*K, "is_duplicate", "duplicate_of")


@query
def og_final_reconcile(spark, sf_dir):
    occ = exact.flag_exact_duplicates(D.occurrences(spark, sf_dir))
    return occ.groupBy("package_id").agg(F.count("*").alias("in_original"), F.count_if("is_duplicate").alias("exact_duplicates"), F.count_if(~F.col("is_duplicate")).alias("in_final"), F.sum("original_size_bytes").alias("bytes"))


@query
def page_explode(spark, sf_dir):
    return D.raw_pages(spark, sf_dir).select(*K, "page_index", F.length("raw_text").alias("n_chars"))


@query
def page_normalize_hash(spark, sf_dir):
    return fingerprint.page_fingerprints(D.raw_pages(spark, sf_dir)).select(*K, "page_index", "text_hash")


@query
def struct_tokens(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    dated = F.concat(T.collapse(F.coalesce("text", F.lit(""))), F.format_string(" due 2026-01-%02d or 1/%d/26 for $%d.50", F.col("doc_id") % 28 + 1, F.col("doc_id") % 28 + 1, F.col("doc_id")))
    found = docs.select("doc_id", dated.alias("t"))
    join = lambda c: F.array_join(c, "|")
    return found.select("doc_id", join(T.date_tokens(F.col("t"))).alias("dates"), join(T.dollar_tokens(F.col("t"))).alias("dollars"), join(T.name_tokens(F.col("t"))).alias("names"))


@query
def blank_pages(spark, sf_dir):
    return fingerprint.page_fingerprints(D.raw_pages(spark, sf_dir)).groupBy("package_id").agg(F.count_if("is_blank").alias("blank"), F.count("*").alias("pages"))


@query
def doc_fingerprint(spark, sf_dir):
    docs = fingerprint.document_fingerprints(fingerprint.page_fingerprints(D.raw_pages(spark, sf_dir)))
    return docs.select(*K, "document_hash", "page_count", "non_blank_pages", F.col("text_length").cast("long").alias("text_length"))


@query
def wrap_lines(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.wrapped(F.col("text"))).alias("line_no", "line"))


@query
def paragraph_chunks(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\n \n").alias("t"))
    return docs.select("doc_id", F.posexplode(T.paragraphs(F.col("t"))).alias("chunk_no", "chunk"))


@query
def garbled_text(spark, sf_dir):
    dense = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", r"\s", "")).otherwise(F.col("text"))
    return D.table(spark, sf_dir, "documents").select("doc_id", T.is_garbled(dense).alias("garbled"))


@query
def disguised_binary(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    heads = F.when(F.col("doc_id") % 4 == 0, F.lit("%PDF-")).when(F.col("doc_id") % 4 == 1, F.lit("PK\x03\x04")).otherwise("")
    coded = F.when(F.col("doc_id") % 4 == 3, F.col("text")).otherwise(F.base64(F.concat(heads, F.col("text")).cast("binary")))
    return docs.select("doc_id", T.disguised_kind(coded).alias("kind"))


@query
def page_totals(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("page "), (F.col("doc_id") % 9).cast("string"), F.lit(" of "), (F.col("doc_id") % 11).cast("string")).alias("t"))
    return docs.select("doc_id", T.page_total(F.col("t")).alias("total"))


# Paths and names.


@query
def safe_paths(spark, sf_dir):
    kind = F.col("page_id") % 4
    path = F.when(kind == 0, F.regexp_replace("url", "^https?:/", "")).when(kind == 1, F.regexp_replace("url", "^https?://", "../")).when(kind == 2, F.regexp_replace("url", "^https?://", "a\\\\./b//")).otherwise(F.col("url"))
    return D.table(spark, sf_dir, "pages").select("page_id", N.safe_path(path).alias("path"))


@query
def ignored_artifacts(spark, sf_dir):
    kind = F.col("page_id") % 5
    path = F.concat(F.regexp_replace("url", "^https?://", ""), F.when(kind == 0, "/.DS_Store").when(kind == 1, "/__MACOSX/x").when(kind == 2, "\\Thumbs.db").otherwise("/x.txt"))
    return D.table(spark, sf_dir, "pages").select("page_id", N.is_artifact(path).alias("ignored"))


@query
def sanitized_names(spark, sf_dir):
    odd = F.concat(F.lit(" ."), F.col("p_name"), F.lit('<>:"  |?*'), F.col("p_type"), F.lit(". "))
    return D.table(spark, sf_dir, "part").select("p_partkey", N.sanitized(odd).alias("name"))


@query
def natural_order(spark, sf_dir):
    named = D.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit(" File"), F.col("p_partkey").cast("string")).alias("name"))
    return named.withColumn("place", F.row_number().over(W.orderBy(N.natural_key(F.col("name")), "p_partkey")))


@query
def folder_identity(spark, sf_dir):
    key = F.col("c_custkey")
    folder = F.when(key % 3 == 0, F.concat_ws(", ", "c_mktsegment", "c_name", key.cast("string"))).when(key % 3 == 1, F.concat_ws(" ,", "c_mktsegment", "c_name")).otherwise(F.col("c_name"))
    last, first, loan = N.identity(folder)
    return D.table(spark, sf_dir, "customer").select("c_custkey", last.alias("last_name"), first.alias("first_name"), loan.alias("loan_number"))


@query
def part_filename(spark, sf_dir):
    key = F.col("c_custkey")
    name = N.part_filename(F.col("c_mktsegment"), F.col("c_name"), F.lit(N.FINAL_KIND), F.when(key % 2 == 0, "Lender: A").otherwise(""), key.cast("string"), (key % 3 + 1).cast("int"), (key % 3 + 1).cast("int"))
    return D.table(spark, sf_dir, "customer").select("c_custkey", name.alias("filename"))


@query
def collision_suffix(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))
    return D.table(spark, sf_dir, "part").select("p_partkey", N.with_copy_number(F.concat("p_type", F.lit(".pdf")), nth).alias("filename"))


# Packing.

PAGES_A_PART = 12
BYTES_A_PART = 1


def _packed(spark, sf_dir):
    return packing.plan_parts(D.packing_input(spark, sf_dir), PAGES_A_PART, BYTES_A_PART)


@query
def plan_parts(spark, sf_dir):
    return _packed(spark, sf_dir).select(*K, "part", "pages")


@query
def close_reasons(spark, sf_dir):
    got = packing.parts(_packed(spark, sf_dir), PAGES_A_PART, BYTES_A_PART)
    return got.select("package_id", "part", "page_count", F.col("n_documents").cast("long").alias("n_documents"), "is_oversized", F.array_join("close_reasons", "|").alias("close_reasons"))


@query
def part_offsets(spark, sf_dir):
    return packing.offsets(_packed(spark, sf_dir)).select(*K, "part", "offset_in_part", "offset_overall")


@query
def oversized_parts(spark, sf_dir):
    got = packing.parts(_packed(spark, sf_dir), PAGES_A_PART, BYTES_A_PART)
    return got.filter("is_oversized").groupBy("package_id").agg(F.count("*").alias("n"), F.max("page_count").alias("largest"))


@query
def package_rollup(spark, sf_dir):
    docs = D.occurrences(spark, sf_dir)
    got = docs.rollup("package_id", F.col("converted_page_count").between(1, 5).alias("short")).agg(F.count("*").alias("documents"), F.sum("converted_page_count").alias("pages"))
    return got.select("package_id", "short", "documents", "pages")


# Content.


def _unique(spark, sf_dir):
    """(documents, pages) of what is no exact duplicate."""
    occ = exact.flag_exact_duplicates(D.occurrences(spark, sf_dir)).filter("not is_duplicate").select(*K, "traversal_index", "is_portfolio_container")
    pages = fingerprint.page_fingerprints(D.raw_pages(spark, sf_dir)).join(occ.select(*K), K, "left_semi")
    return fingerprint.document_fingerprints(pages).join(occ, K), pages


@query
def bucket_stats(spark, sf_dir):
    return content.bucket_stats(_unique(spark, sf_dir)[0]).groupBy("package_id").agg(F.count("*").alias("buckets"), F.max("members").alias("largest"), F.sum("pairs").alias("pairs"), F.count_if("capped").alias("capped"))


@query
def candidate_pairs(spark, sf_dir):
    return content.candidate_pairs(_unique(spark, sf_dir)[0]).select("package_id", "a_id", "b_id")


@query
def hash_only_groups(spark, sf_dir):
    docs, pages = _unique(spark, sf_dir)
    return content.oversized_groups(docs, pages).select("package_id", "a_id", "b_id")


@query
def pair_compare(spark, sf_dir):
    docs, pages = _unique(spark, sf_dir)
    got = content.compared_pairs(content.candidate_pairs(docs), content.non_blank(pages))
    return got.filter("verdict <> 'no_match'").select("package_id", "a_id", "b_id", "verdict", F.round("confidence", 6).alias("confidence"), F.array_join("vetoes", "|").alias("vetoes"))


@query
def content_groups(spark, sf_dir):
    engine.ensure_checkpoints(spark)
    return content.content_groups(*_unique(spark, sf_dir))["members"]


@query
def uncertain_pairs(spark, sf_dir):
    engine.ensure_checkpoints(spark)
    return content.content_groups(*_unique(spark, sf_dir))["uncertain"].drop("ia", "ib")


@query
def canonical_pick(spark, sf_dir):
    docs = fingerprint.document_fingerprints(fingerprint.page_fingerprints(D.raw_pages(spark, sf_dir))).join(D.occurrences(spark, sf_dir).select(*K, "traversal_index", "is_portfolio_container"), K)
    return content.canonical(docs, ["package_id", "document_hash"]).filter("members > 1")


@query
def exact_containment(spark, sf_dir):
    return containment.exact_containment(*D.merged_pages(spark, sf_dir)).select("package_id", "document_id", "container_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query
def partial_overlap(spark, sf_dir):
    got = containment.partial_overlap(*D.merged_pages(spark, sf_dir))
    return got.select("package_id", "document_id", "container_id", F.col("run").cast("long").alias("run"), F.round("share", 6).alias("share"))


@query
def components(spark, sf_dir):
    first = D.table(spark, sf_dir, "documents").filter("text is not null").select(F.coalesce("lang", F.lit("?")).alias("package_id"), "doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.length("line") > 3)
    hub = first.groupBy("package_id", F.sha2("line", 256).alias("h")).agg(F.min("doc_id").alias("b"))
    edges = first.withColumn("h", F.sha2("line", 256)).join(hub, ["package_id", "h"]).filter("doc_id <> b").select("package_id", F.col("doc_id").alias("a"), "b")
    return graph.components(edges)


@query
def related_families(spark, sf_dir):
    engine.ensure_checkpoints(spark)
    docs, pages = _unique(spark, sf_dir)
    return families.families(families.related(docs, content.non_blank(pages)))


# Key documents. The tables hold none, so marked pages are made from document ids.


def _marked_pages(spark, sf_dir):
    texts = [
        "closing disclosure page 1 of 5 loan terms projected payments", "page 2 of 5 loan costs", "closing disclosure page 3 of 5 cash to close", "loan estimate page 1 of 3 save this loan estimate to compare with your closing disclosure",
        "loan estimate page 2 of 3 closing cost details comparisons", "alta settlement statement seller american land title association financial loan charges to", "notice of denial", "we are unable to proceed with your loan", "ordinary page",
    ]
    docs = D.table(spark, sf_dir, "documents").select(F.lit("P").alias("package_id"), F.format_string("DOC-%06d", "doc_id").alias("document_id"), F.col("doc_id").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("page_index"))
    chosen = F.get(F.array(*map(F.lit, texts)), ((F.col("d") * 7 + F.col("page_index") * F.col("page_index") * 5) % len(texts)).cast("int"))
    return fingerprint.page_fingerprints(conform(docs.withColumn("raw_text", chosen), RAW_PAGES))


@query
def key_doc_ranges(spark, sf_dir):
    found = keydocs.find_key_documents(_marked_pages(spark, sf_dir))
    return found.select("document_id", "category", "subtype", "confidence_band", "first_page", "last_page", "signature_status")


@query
def key_doc_counts(spark, sf_dir):
    found = keydocs.find_key_documents(_marked_pages(spark, sf_dir))
    return found.groupBy("category", "confidence_band").agg(F.count("*").alias("n"), F.sum((F.col("confidence") * 100).cast("int")).alias("points"))


@query
def gaps_islands(spark, sf_dir):
    lines = D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page_index", "line")).filter(F.col("line").contains("tion"))
    return keydocs.islands(lines, 1, ["doc_id"])


# Comparison of packages: a language's documents among each COMPARED neighbouring ids against the same with one line moved.

COMPARED = 40


def _sides(spark, sf_dir):
    block = F.floor((F.substring("document_id", 5, 20).cast("long") - 1) / COMPARED)
    raw = D.raw_pages(spark, sf_dir).withColumn("package_id", F.concat_ws("-", "package_id", block.cast("string")))
    pages = fingerprint.page_fingerprints(raw).withColumn("file_order", F.col("document_id"))
    moved = pages.filter("page_index <> 1 or document_id like '%7'").withColumn("page_index", F.when(F.col("document_id").endswith("3"), -F.col("page_index")).otherwise(F.col("page_index")))
    return pages, moved


@query
def compare_packages(spark, sf_dir):
    return alignment.compare_packages(*_sides(spark, sf_dir))


@query
def compare_categories(spark, sf_dir):
    return alignment.categories(alignment.compare_packages(*_sides(spark, sf_dir)))


# Runs.


def _run(spark, sf_dir, aware=True):
    raw = D.raw_pages(spark, sf_dir)
    return engine.build(D.occurrences(spark, sf_dir), raw, Config(max_pages_per_part=100, content_aware=aware), rehashed=D.rehashed(raw))


@query
def integrity_checks(spark, sf_dir):
    return _run(spark, sf_dir).checks


@query
def duplicate_log(spark, sf_dir):
    return reports.duplicate_log(_run(spark, sf_dir, False).occurrences)


@query
def processing_report(spark, sf_dir):
    run = _run(spark, sf_dir, False)
    return reports.processing_report(run.occurrences, run.pages)


def _part_rows(run):
    return run.final_parts.select("package_id", F.col("part").cast("int").alias("part"), "page_count", F.col("n_documents").cast("long").alias("n_documents"), F.array_join("document_ids", "|").alias("documents"))


@query
def final_parts(spark, sf_dir):
    return _part_rows(_run(spark, sf_dir, False))


@query
def version_report(spark, sf_dir):
    run = _run(spark, sf_dir)
    return reports.version_report(run.occurrences, run.versions)


@query
def overlap_report(spark, sf_dir):
    return reports.overlap_report(_run(spark, sf_dir).overlaps)


@query
def batch_summary(spark, sf_dir):
    return _run(spark, sf_dir).success()


@query
def manifest_json(spark, sf_dir):
    return reports.manifest(_run(spark, sf_dir).occurrences)


# The three reports above with SQL are those of exact duplicates alone; these are of the whole run, which has no SQL.


@query
def content_duplicate_log(spark, sf_dir):
    return reports.duplicate_log(_run(spark, sf_dir).occurrences)


@query
def content_processing_report(spark, sf_dir):
    run = _run(spark, sf_dir)
    return reports.processing_report(run.occurrences, run.sketches)


@query
def content_final_parts(spark, sf_dir):
    return _part_rows(_run(spark, sf_dir))


@query
def version_groups(spark, sf_dir):
    run = _run(spark, sf_dir)
    return reports.version_groups(reports.version_report(run.occurrences, run.versions))


@query
def processing_lines(spark, sf_dir):
    run = _run(spark, sf_dir)
    return reports.processing_lines(run.occurrences, run.original_parts, run.final_parts, run.checks)


@query
def part_lines(spark, sf_dir):
    return reports.part_lines(packing.parts(_packed(spark, sf_dir), PAGES_A_PART, BYTES_A_PART))


@query
def rebuilt_parts(spark, sf_dir):
    """The planned parts when a document has as many bytes as pages and a part may have 10."""
    members = _packed(spark, sf_dir)
    return packing.rebuilt(members, members.select(*K, F.col("pages").alias("bytes")), 10)


@query
def extracted_pages(spark, sf_dir):
    pages = _marked_pages(spark, sf_dir)
    docs = D.table(spark, sf_dir, "documents").select(F.lit("P").alias("package_id"), F.format_string("DOC-%06d", "doc_id").alias("document_id"), F.col("doc_id").alias("traversal_index"))
    return sinks.extracted_pages(keydocs.numbered(keydocs.find_key_documents(pages), docs), pages).select("document_id", "category", F.col("page_index").cast("long").alias("page_index"))


@query
def key_document_report(spark, sf_dir):
    """Packages of 40 neighbouring documents."""
    block = F.floor(F.substring("document_id", 5, 20).cast("long") / COMPARED)
    pages = _marked_pages(spark, sf_dir).withColumn("package_id", F.concat(F.lit("P-"), block.cast("string")))
    docs = pages.select(*K).distinct().withColumns({"traversal_index": F.substring("document_id", 5, 20).cast("int"), "original_filename": F.concat("document_id", F.lit(".pdf"))})
    return reports.key_document_report(docs, keydocs.numbered(keydocs.find_key_documents(pages), docs.drop("original_filename")))


@query
def comparison_manifest(spark, sf_dir):
    return reports.comparison_manifest(alignment.compare_packages(*_sides(spark, sf_dir)))


# Sources and signals.


@query
def source_hashes(spark, sf_dir):
    """Packages of 40 neighbouring documents of a language, even ids against odd ones."""
    docs = D.table(spark, sf_dir, "documents").filter("text is not null")
    package = F.concat_ws("-", F.coalesce("lang", F.lit("?")), F.floor(F.col("doc_id") / COMPARED).cast("string"))
    return sinks.source_hash(docs.select(package.alias("package_id"), (F.col("doc_id") % 2).cast("int").alias("side"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha")))


@query
def output_folders(spark, sf_dir):
    """Half of the customers go by name, half by source and time."""
    named, none = F.col("c_custkey") % 2 == 0, F.lit("")
    name = N.output_folder(F.when(named, F.col("c_mktsegment")).otherwise(""), F.when(named, F.col("c_name")).otherwise(""), F.lit(False), none, none, F.concat("c_name", F.lit(".zip")), F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    return D.table(spark, sf_dir, "customer").select("c_custkey", name.alias("folder"))


@query
def unconverted_targets(spark, sf_dir):
    """Five paths for each 40 neighbouring pages, so most carry an id."""
    page = F.col("page_id")
    lost = D.table(spark, sf_dir, "pages").select(
        F.floor(page / COMPARED).cast("string").alias("package_id"), F.format_string("DOC-%06d", page.cast("long")).alias("document_id"), page.alias("traversal_index"),
        F.concat(F.lit("in//"), (page % 5).cast("string"), F.lit(".eml")).alias("original_relative_path"), F.lit("unconverted_placeholder").alias("status"),
    )
    return sinks.unconverted_copies(lost)


@query
def bundled_names(spark, sf_dir):
    files = D.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / COMPARED).cast("string").alias("package_id"), F.col("p_partkey").alias("at"), F.concat(F.element_at(F.split("p_type", " "), 1), F.lit(".txt")).alias("name"))
    return sinks.bundled(files)


@query
def history_entries(spark, sf_dir):
    """A log with a broken line for every third document."""
    line = F.to_json(F.struct(F.coalesce("lang", F.lit("")).alias("last_name"), F.col("source").alias("first_name"), F.col("doc_id").cast("string").alias("loan_number"), (F.col("doc_id") % 2 == 0).alias("is_adverse"), F.col("n_chars").cast("int").alias("document_count")))
    log = D.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "{broken").otherwise(line).alias("value"))
    return sinks.history_rows(log).select("last_name", "first_name", "loan_number", "is_adverse", F.col("document_count").cast("long").alias("document_count"), "status")


@query
def html_blocks(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", F.posexplode(decoders.blocks_of_html("html")).alias("block_no", "block"))


@query
def exact_normalized(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.exact_normal("text"), 256).alias("sha"))


def _grid(spark, sf_dir):
    vectors = D.table(spark, sf_dir, "embeddings")
    bits = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.when(F.get("embedding", i) < F.get("embedding", i + 1), F.lit(1)).otherwise(0).cast("long"))
    return vectors.select("vec_id", "label", "embedding", F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b)).alias("h"))


@query
def difference_hashes(spark, sf_dir):
    return _grid(spark, sf_dir).select("vec_id", F.col("h").alias("dhash"))


@query
def difference_hash_grid(spark, sf_dir):
    """The hash function itself, over each vector as an 8 x 8 picture."""
    return D.table(spark, sf_dir, "embeddings").select("vec_id", S.difference_hash(F.col("embedding"), 8, 8).alias("dhash"))


@query
def blank_images(spark, sf_dir):
    """Vectors as grey pixels from 0 to 255; the first third of the labels is nearly white."""
    shade = F.when(F.col("label") < 4, 254).otherwise(0)
    pixels = F.transform("embedding", lambda x: F.greatest(shade, F.least(F.lit(255), F.floor(F.abs(x.cast("double")) * 1000))).cast("int"))
    return D.table(spark, sf_dir, "embeddings").select("vec_id", S.is_blank_image(pixels).alias("is_blank"))


@query
def shortened_paths(spark, sf_dir):
    path = F.concat(F.translate("text", "\n", "/"), F.lit(".pdf"))
    return D.table(spark, sf_dir, "documents").select("doc_id", N.shortened(path).alias("path"))


@query
def admitted_entries(spark, sf_dir):
    """Entries of a package in order while it has at most 150 of them and 300,000 bytes."""
    return inventory.over_limits(D.occurrences(spark, sf_dir), 150, 300_000).select(*K, "admitted")


@query
def hamming_distances(spark, sf_dir):
    g = _grid(spark, sf_dir)
    after = F.lead("h").over(W.partitionBy("label").orderBy("vec_id"))
    return g.withColumn("n", after).filter("n is not null").select("vec_id", S.hamming(F.col("h"), F.col("n")).cast("long").alias("distance"))


@query
def color_distances(spark, sf_dir):
    c = lambda k: F.abs(F.round(F.get("embedding", F.lit(k)).cast("double") * 255))
    g = D.table(spark, sf_dir, "embeddings").select("vec_id", F.struct(c(0).alias("r"), c(1).alias("g"), c(2).alias("b")).alias("x"), F.struct(c(3).alias("r"), c(4).alias("g"), c(5).alias("b")).alias("y"))
    return g.select("vec_id", F.round(S.color_similarity(F.col("x"), F.col("y")), 9).alias("similarity"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue_sql.SQL)
