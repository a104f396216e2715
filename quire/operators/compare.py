"""The comparison of pages and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import signals as S
from quire.functions import text as T

# Fixed values.
VETOES = ["signature_field", "signed", "image_count", "form_values", "annotations", "dates", "dollar_amounts", "name_hints"]
RANK = {"no_match": 0, "different_version": 1, "uncertain": 2, "same": 3}

PAGE = ["text_hash", "normalized_text", "images", "form_fields", "annotations", "has_signature_field", "has_signed_signature", "dates", "dollars", "names", "bag"]

#: What marks() adds.
MARKS = ["e", "v", "n", "s0", "s1", "s2", "s3"]


def form_values(fields: Column) -> Column:
    """Names, types and values in order of name; of several fields of a name the last counts. No value isn't an empty one."""
    last = F.filter(fields, lambda f, i: ~F.exists(F.slice(fields, i + 2, F.size(fields)), lambda g: g["name"] == f["name"]))
    return F.array_sort(F.transform(last, lambda f: F.struct(f["name"].alias("n"), f["field_type"].alias("t"), f["value"].alias("v"))))


def annotation_set(notes: Column) -> Column:
    return F.array_sort(F.array_distinct(notes))


def _bytes(images: Column) -> Column:
    return F.transform(images, lambda i: i["byte_sha256"])


def page_is_equal(a, b) -> Column:
    """The exact shortcut: text, images in order, form values, annotations and signatures all agree."""
    same = lambda x, y: x.eqNullSafe(y)
    return (
        same(a["text_hash"], b["text_hash"]) & same(_bytes(a["images"]), _bytes(b["images"])) & same(form_values(a["form_fields"]), form_values(b["form_fields"])) & same(annotation_set(a["annotations"]), annotation_set(b["annotations"]))
        & (a["has_signature_field"] == b["has_signature_field"]) & (a["has_signed_signature"] == b["has_signed_signature"])
    )


def page_veto(a, b) -> Column:
    """The first of VETOES that tells two pages apart; null if none does."""
    rules = [
        a["has_signature_field"] != b["has_signature_field"], a["has_signed_signature"] != b["has_signed_signature"], F.size(a["images"]) != F.size(b["images"]),
        ~form_values(a["form_fields"]).eqNullSafe(form_values(b["form_fields"])), ~annotation_set(a["annotations"]).eqNullSafe(annotation_set(b["annotations"])),
        a["dates"] != b["dates"], a["dollars"] != b["dollars"], a["names"] != b["names"],
    ]
    out = F.lit(None).cast("string")
    for name, rule in reversed(list(zip(VETOES, rules, strict=True))):
        out = F.when(rule, name).otherwise(out)
    return out


def marks(pages: DataFrame) -> DataFrame:
    """Pages with MARKS, which alike() compares in place of texts: e is equal where the exact shortcut holds, v where nothing is vetoed; n counts
    words, and each distinct word sets one bit of s0 to s3. Sketches have them already."""
    if set(MARKS) <= set(pages.columns):
        return pages.select("package_id", "document_id", "ord", "text_hash", *MARKS)
    return pages.select("package_id", "document_id", "ord", "text_hash", *mark_columns())


def mark_columns() -> list[Column]:
    fields, notes = form_values(F.col("form_fields")), annotation_set(F.col("annotations"))
    signs = ["has_signature_field", "has_signed_signature"]
    d = F.col("bag.d")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    own = lambda i: F.filter(d, lambda x: x.bitwiseAND(F.lit(192).cast("long")) == F.lit(i << 6).cast("long"))  # noqa: E731 (a quarter of the words meets the fold)
    bits = lambda i: F.aggregate(own(i), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x)))
    e = F.xxhash64("text_hash", F.transform("images", lambda i: i["byte_sha256"]), fields, notes, *signs)
    lists = ["dates", "dollars", "names"]
    v = F.xxhash64(F.size("images"), F.to_json(fields), F.to_json(notes), *signs, *[F.size(x) for x in lists], *lists)  # tells where each list ends, and a missing value from its neighbour
    return [e.alias("e"), v.alias("v"), F.col("bag.n").alias("n"), *[bits(i).alias(f"s{i}") for i in range(4)]]


def _common(a, b) -> Column:
    """How many words two pages have in common at most. No bound is lowered by words that share a bit."""
    lacks = lambda x, y: sum((F.bit_count(x(f"s{i}").bitwiseAND(F.bitwise_not(y(f"s{i}")))) for i in range(4)), F.lit(0))
    return F.least(a("n") - lacks(a, b), b("n") - lacks(b, a))


def alike(a, b, floor: float) -> Column:
    """Whether two pages, by their marks, may be alike: equal, or without veto and with words enough in common for the ratio to reach floor.

    No bound is lowered by words that share a bit, so what is alike is never left out.
    """
    return (a("e") == b("e")) | ((a("v") == b("v")) & (2.0 * _common(a, b) >= floor * (a("n") + b("n")) - 1e-6))


def alike_bound(a, b) -> Column:
    """The most that the confidence of two pages can be by their marks; -1 if they are vetoed."""
    total = a("n") + b("n")
    return F.when(a("e") == b("e"), 1.0).when(a("v") != b("v"), -1.0).when(total == 0, 1.0).otherwise(2.0 * _common(a, b) / F.greatest(total, F.lit(1)))


def compare_pages(pairs: DataFrame, floor: float = 0.0) -> DataFrame:
    """Adds veto, confidence and exact to rows with structs a and b of PAGE columns.

    Equal pages have 1, vetoed ones 0. Only what is left meets the sequence matcher, and of that only pairs whose bag of words lets
    the ratio reach floor; the others keep that bound, which lies below floor. Both branches are told apart before the Python
    function, as it would run for all rows inside a CASE.
    """
    a, b = F.col("a"), F.col("b")
    df = pairs.withColumn("exact", page_is_equal(a, b)).withColumn("veto", F.when(~F.col("exact"), page_veto(a, b)))
    df = df.withColumn("bound", F.when(F.col("exact"), 1.0).when(F.col("veto").isNotNull(), 0.0).when(a["text_hash"] == b["text_hash"], 1.0).otherwise(T.bag_bound(a["bag"], b["bag"])))
    hard = ~F.col("exact") & F.col("veto").isNull() & (F.col("bound") >= floor) & (a["text_hash"] != b["text_hash"])
    measured = df.filter(hard).withColumn("words", T.word_ratio(F.col("a.normalized_text"), F.col("b.normalized_text")))
    settled = df.filter(~hard).withColumn("words", F.col("bound"))
    both = measured.unionByName(settled)
    images = S.images_similarity(a["images"], b["images"])
    confidence = F.when(F.col("exact"), 1.0).when(F.col("veto").isNotNull(), 0.0).otherwise(F.least(F.col("words"), F.coalesce(images, F.lit(1.0))))
    return both.withColumn("confidence", confidence).drop("bound", "words")


def of_documents(pages: DataFrame | Callable[[DataFrame], DataFrame], named: DataFrame) -> DataFrame:
    """The pages of the documents that named has; pages may be a function that makes them of named."""
    return pages(named) if callable(pages) else pages.join(named, ["package_id", "document_id"], "left_semi")


def page_structs(pages: DataFrame, side: str) -> DataFrame:
    """(package_id, document_id as side, ord, side as a struct): pages numbered from 0 as they are in the table."""
    return pages.select("package_id", F.col("document_id").alias(f"{side}_id"), "ord", F.struct(*PAGE).alias(side))


def document_verdicts(page_results: DataFrame, same_at: float = 0.95, uncertain_at: float = 0.80) -> DataFrame:
    """A row a pair (package_id, a_id, b_id) of its pages' results: the weakest page decides."""
    agg = page_results.groupBy("package_id", "a_id", "b_id").agg(
        F.min("confidence").alias("confidence"), F.bool_and("exact").alias("all_exact"), F.array_sort(F.collect_set("veto")).alias("vetoes"),
        F.bool_and(F.col("a.text_hash") == F.col("b.text_hash")).alias("all_hashes"), F.count("*").alias("pages"),
    )
    verdict = F.when(F.size("vetoes") > 0, "different_version").when(F.col("confidence") >= same_at, "same").when(F.col("confidence") >= uncertain_at, "uncertain").otherwise("no_match")
    return agg.withColumn("verdict", verdict)


def compare_band(confidence: Column, veto: Column) -> Column:
    """The category of a pair of pages of two packages."""
    return F.when(veto.isNotNull(), "Meaningful Difference").when(confidence >= 0.999, "Exact Match").when(confidence >= 0.95, "Equivalent Content").when(confidence >= 0.80, "Same Document, Different Version").otherwise("Meaningful Difference")
