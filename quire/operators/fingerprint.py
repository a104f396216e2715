"""Page and document fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

BLANK_CHARS = 3


def page_fingerprints(pages: DataFrame, exact: bool = False) -> DataFrame:
    """A row a page: texts, hash, tokens, signature flags, blank or not. exact: NFKC and full case folding (Arrow) instead of the JVM's."""
    raw = F.coalesce("raw_text", F.lit(""))
    df = pages.withColumn("collapsed", T.exact_collapse(raw) if exact else T.collapse(raw))
    df = df.withColumn("normalized_text", T.exact_normal(raw) if exact else T.fold(F.col("collapsed")))
    fields, notes, images = (F.coalesce(c, F.array()) for c in ("form_fields", "annotations", "images"))
    df = df.withColumns({"form_fields": fields, "annotations": notes, "images": images})
    signature = F.filter("form_fields", lambda f: f["field_type"] == "/Sig")
    marked = F.exists("annotations", lambda a: (F.length(F.coalesce(a["contents"], F.lit(""))) > 0) | F.coalesce(a["has_appearance_stream"], F.lit(False)))
    empty = (F.length("normalized_text") <= BLANK_CHARS) & (F.size("form_fields") == 0) & ~marked & F.forall("images", lambda i: F.coalesce(i["is_blank"], F.lit(False)))
    return df.withColumns({
        "text_hash": F.sha2("normalized_text", 256), "bag": T.bag(F.filter(F.split("normalized_text", " "), lambda w: w != "")), "dates": T.date_tokens(F.col("collapsed")), "dollars": T.dollar_tokens(F.col("collapsed")), "names": T.name_tokens(F.col("collapsed")),
        "has_signature_field": F.size(signature) > 0, "has_signed_signature": F.exists(signature, lambda f: F.length(F.coalesce(f["value"], F.lit(""))) > 0),
        "has_form_fields": F.size("form_fields") > 0, "is_blank": empty, "blank_confidence": F.when(empty, F.when(F.size("images") > 0, 0.9).otherwise(1.0)),
    })


def document_fingerprints(pages: DataFrame, *more: Column) -> DataFrame:
    """A row a document: its hash is that of its pages' hashes in order. pages: fingerprints or sketches; more: further aggregates."""
    had = lambda name, made: F.col(name) if name in pages.columns else made
    length, imaged = had("text_length", F.length("normalized_text")), had("has_images", F.size("images") > 0)
    dims = had("dims", F.struct(F.round("width", 1).alias("w"), F.round("height", 1).alias("h")))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text_hash"))), lambda x: x["text_hash"])
    return pages.groupBy("package_id", "document_id").agg(
        F.sha2(F.concat_ws("|", hashes), 256).alias("document_hash"), F.count("*").cast("int").alias("page_count"), F.count_if(~F.col("is_blank")).cast("int").alias("non_blank_pages"),
        F.bool_or("has_signature_field").alias("has_signature_field"), F.bool_or("has_signed_signature").alias("has_signed"), F.bool_or("has_form_fields").alias("has_form_fields"),
        F.sum(length).alias("text_length"), F.count_if("is_blank").cast("int").alias("blank_pages"),
        F.min_by(dims, "page_index").alias("dims"),
        F.count_if(~F.col("is_blank") & imaged).cast("int").alias("image_pages"),
        F.count_if(~F.col("is_blank") & imaged & (length < 50)).cast("int").alias("scan_pages"), *more,
    )


def with_bucket(docs: DataFrame) -> DataFrame:
    """Documents can only be duplicates within (package, non-blank pages, first page's size, has a signature field, has form fields)."""
    return docs.withColumn("bucket", F.concat_ws("/", F.col("non_blank_pages").cast("string"), F.coalesce(F.col("dims.w").cast("string"), F.lit("")), F.coalesce(F.col("dims.h").cast("string"), F.lit("")), F.col("has_signature_field").cast("string"), F.col("has_form_fields").cast("string")))
