"""Reports as queries; each is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = "package_id"
# Fixed values.
METHODS = ["exact", "normalized_pdf", "content_equivalent", "blank_page_tolerant"]
CLOSED = {"page_maximum": "the next document would exceed the page maximum", "size_maximum": "the next document would exceed the size maximum", "oversized_document": "one document is larger than a part may be", "end_of_package": "end of the package"}
SIGNED_CATEGORY = "closing_disclosure"
CLASSES = ["exact_contained", "equivalent_contained", "uncertain_overlap", "different_version", "partial_overlap"]


def exclusion_reason() -> Column:
    """Why a document isn't in Final, a person's decision first; null if it is."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    of = lambda text, c: F.concat(F.lit(text), F.coalesce(c, F.lit("?")))
    return F.when(~F.col("included_in_final"), F.when(flag("manually_excluded"), of("excluded by decision on ", F.col("manually_excluded_match_id"))).when(flag("is_ignored_artifact"), "system artifact")
        .when(flag("is_duplicate"), of("exact duplicate of ", F.col("duplicate_of"))).when(flag("is_content_duplicate"), of("same content as ", F.col("content_duplicate_of")))
        .when(flag("is_contained"), of("contained in ", F.col("contained_in"))).when(flag("is_portfolio_container"), "portfolio container").otherwise("unexplained"))


def duplicate_log(occ: DataFrame) -> DataFrame:
    """(package_id, method, retained_id, document_id): what was removed as a duplicate; what needs review isn't."""
    exact = occ.filter("is_duplicate").select(K, F.lit("exact").alias("method"), F.col("duplicate_of").alias("retained_id"), "document_id")
    content = occ.filter("coalesce(is_content_duplicate, false) and not coalesce(needs_review, false)").select(K, F.col("duplicate_method").alias("method"), F.col("content_duplicate_of").alias("retained_id"), "document_id")
    return exact.unionByName(content)


def duplicate_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(K, "method").agg(F.count("*").alias("n"), F.count_distinct("retained_id").alias("groups"))


def version_report(occ: DataFrame, versions: DataFrame) -> DataFrame:
    """(package_id, family, version, document_id, retained, reason) of families' members; versions: families.version_labels()."""
    return versions.filter("family is not null").select(K, "document_id", "family", "version").join(occ, [K, "document_id"]).select(K, "family", "version", "document_id", F.col("included_in_final").alias("retained"), exclusion_reason().alias("reason"))


def overlap_report(found: DataFrame) -> DataFrame:
    """(package_id, classification, n) in the report's order of classes."""
    rank = F.create_map(*[F.lit(x) for j, c in enumerate(CLASSES) for x in (c, j)])
    return found.groupBy(K, "classification").agg(F.count("*").alias("n")).withColumn("class_order", F.element_at(rank, F.col("classification")))


def uncertain_report(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Matches with what was decided; state is decided or awaiting."""
    done = decisions.filter("accepted").select(K, "match_id", "decision", F.col("document_id").alias("decided_document_id"), "decided_at")
    return matches.join(done, [K, "match_id"], "left").withColumn("state", F.when(F.col("decision").isNull(), "awaiting").otherwise("decided"))


def processing_report(occ: DataFrame, pages: DataFrame) -> DataFrame:
    """A row a package: counts of documents by what became of them, pages and distinct contents."""
    n = pages.groupBy(K).agg(F.count("*").alias("pages"), F.count_if("is_blank").alias("blank_pages"), F.count_distinct("text_hash").alias("distinct_pages"))
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    got = occ.groupBy(K).agg(
        F.count("*").alias("found"), flag("is_ignored_artifact").alias("ignored"), flag("is_duplicate").alias("exact_duplicates"), flag("is_content_duplicate").alias("content_duplicates"), flag("is_contained").alias("contained"),
        flag("needs_review").alias("needs_review"), F.count_if(F.col("status") == "unconverted_placeholder").alias("placeholders"), F.count_if("included_in_final").alias("in_final"), F.count_distinct("original_sha256").alias("distinct_hashes"),
    )
    return got.join(n, K, "left")


def batch_summary(checks: DataFrame, occ: DataFrame) -> DataFrame:
    """A row a package: its documents, and whether all checks passed."""
    ok = checks.groupBy(K).agg(F.bool_and("passed").alias("success"), F.count_if(~F.col("passed")).alias("failed_checks"))
    return occ.groupBy(K).agg(F.count("*").alias("documents"), F.count_if("included_in_final").alias("in_final")).join(ok, K)


def manifest(occ: DataFrame) -> DataFrame:
    """(package_id, document_id, json): every column of an occurrence."""
    return occ.select(K, "document_id", F.to_json(F.struct(*occ.columns)).alias("json"))


def wet_signed(matches: DataFrame) -> DataFrame:
    return matches.filter("signature_status = 'Signed'")


def close_text(reasons: Column) -> Column:
    """Why a part ended, in words; unknown without a reason."""
    words = F.create_map(*[F.lit(x) for kv in CLOSED.items() for x in kv])
    said = F.array_join(F.transform(reasons, lambda r: F.coalesce(F.element_at(words, r), r)), "; ")
    return F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, said).otherwise("unknown")


def part_lines(parts: DataFrame) -> DataFrame:
    """(package_id, part, line): a part in one line."""
    large = F.when(F.col("is_oversized"), " (one oversized document)").otherwise("")
    line = F.concat(F.format_string("%d documents, %d pages, ", F.col("n_documents").cast("long"), F.col("page_count").cast("long")), F.format_number(F.col("file_size_bytes").cast("long"), 0), F.lit(" bytes"), large, F.lit(": "), close_text(F.col("close_reasons")))
    return parts.select(K, "part", line.alias("line"))


def key_document_report(occ: DataFrame, matches: DataFrame) -> DataFrame:
    """(package_id, section, match_id, category, filename, pages): the matches of each package, the signed ones again, and what wasn't found.

    section is match, wet_signed, or not_found: without any match (category null) and without a signed closing disclosure. matches: key_documents of a run.
    """
    named = matches.join(occ.select(K, "document_id", F.coalesce("original_filename", "document_id").alias("filename")), [K, "document_id"], "left")
    row = named.select(K, "match_id", "category", "filename", F.concat_ws("-", "first_page", "last_page").alias("pages"), "signature_status")
    signed = row.filter("signature_status = 'Signed'")
    none = F.lit(None).cast("string")
    missing = lambda found, category: occ.select(K).distinct().join(found.select(K).distinct(), K, "left_anti").select(K, F.lit("not_found").alias("section"), none.alias("match_id"), category.alias("category"), none.alias("filename"), none.alias("pages"))
    put = lambda df, section: df.select(K, F.lit(section).alias("section"), "match_id", "category", "filename", "pages")
    shown = put(signed, "wet_signed").unionByName(put(row, "match"))
    return shown.unionByName(missing(signed.filter(F.col("category") == SIGNED_CATEGORY), F.lit(SIGNED_CATEGORY))).unionByName(missing(row, none))


def portfolio_report(occ: DataFrame) -> DataFrame:
    """(package_id, parent_id, document_id, position): each portfolio's attachments in order; a portfolio without any has one row of nulls."""
    parents = occ.filter("is_portfolio_container").select(K, F.col("document_id").alias("parent_id"))
    place = F.row_number().over(W.partitionBy(K, "portfolio_parent_document_id").orderBy("traversal_index"))
    inside = occ.filter("portfolio_parent_document_id is not null").select(K, F.col("portfolio_parent_document_id").alias("parent_id"), "document_id", place.alias("position"))
    return parents.join(inside, [K, "parent_id"], "left")


def version_groups(report: DataFrame) -> DataFrame:
    """(package_id, family, version, members, retained): version_report() by version; a version's members are ids in order."""
    return report.groupBy(K, "family", "version").agg(F.array_sort(F.collect_list("document_id")).alias("members"), F.count_if("retained").alias("retained"))


def processing_lines(occ: DataFrame, og_parts: DataFrame, final_parts: DataFrame, checks: DataFrame) -> DataFrame:
    """(package_id, section, item, line): totals, parts, placeholders, blocked paths and checks, one row a line of the processing report."""
    n = lambda e: e.cast("long").cast("string")
    path = F.col("original_relative_path" if "original_relative_path" in occ.columns else "original_filename")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    live = ~flag("is_ignored_artifact")
    counts = {
        "found": F.count("*"), "ignored": F.count_if(~live), "converted": F.count_if(live & (F.col("status") == "converted")), "placeholders": F.count_if(live & (F.col("status") == "unconverted_placeholder")),
        "exact duplicates": F.count_if(live & flag("is_duplicate")), "distinct hashes": F.count_distinct(F.when(live, F.col("original_sha256"))), "pages of exact duplicates": F.coalesce(F.sum(F.when(live & flag("is_duplicate"), F.col("converted_page_count"))), F.lit(0)),
    }
    totals = occ.groupBy(K).agg(F.array(*[F.struct(F.lit(name).alias("item"), n(e).alias("line")) for name, e in counts.items()]).alias("c")).select(K, F.lit("inventory").alias("section"), F.inline("c"))

    def of_parts(parts: DataFrame, name: str) -> DataFrame:
        sums = parts.groupBy(K).agg(F.array(*[F.struct(F.lit(i).alias("item"), n(e).alias("line")) for i, e in (("documents", F.sum("n_documents")), ("pages", F.sum("page_count")))]).alias("c"))
        return sums.select(K, F.lit(name).alias("section"), F.inline("c")).unionByName(part_lines(parts).select(K, F.lit(name).alias("section"), F.format_string("part %03d", F.col("part").cast("int")).alias("item"), "line"))

    listed = lambda rows, section, line: rows.select(K, F.lit(section).alias("section"), F.col("document_id").alias("item"), line.alias("line"))
    lost = listed(occ.filter(live & (F.col("status") == "unconverted_placeholder")), "placeholders", F.coalesce(path, F.lit("")))
    blocked = listed(occ.filter(F.startswith(path, F.lit("BLOCKED_UNSAFE_PATH/"))), "blocked paths", path)
    verdict = checks.select(K, F.lit("checks").alias("section"), F.format_string("%02d %s", F.col("number").cast("int"), F.col("name")).alias("item"), F.when(F.col("passed"), "passed").otherwise(F.concat(F.lit("failed: "), F.col("failures").cast("string"))).alias("line"))
    return totals.unionByName(of_parts(og_parts, "original")).unionByName(of_parts(final_parts, "final")).unionByName(lost).unionByName(blocked).unionByName(verdict)


def comparison_manifest(findings: DataFrame) -> DataFrame:
    """(package_id, finding_id, json): every finding of a comparison of packages."""
    return findings.select(K, "finding_id", F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("json"))
