"""Duplicates by content."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.compare import MARKS, PAGE, alike_bound, annotation_set, compare_pages, document_verdicts, form_values, marks, of_documents
from quire.operators.fingerprint import with_bucket
from quire.operators.graph import components

#: Documents of a bucket are compared in blocks of about so many, each block with each.
BLOCK = 2048


def eligible(occ: DataFrame) -> DataFrame:
    """What takes part: neither ignored nor an exact duplicate, and converted."""
    return occ.filter("not is_ignored_artifact and not is_duplicate and status = 'converted'")


def non_blank(pages: DataFrame) -> DataFrame:
    """Pages with ord, their place among the document's non-blank pages."""
    order = W.partitionBy("package_id", "document_id").orderBy("page_index")
    return pages.filter("not is_blank").withColumn("ord", F.row_number().over(order) - 1)


def signature_of_pages(pages: DataFrame) -> DataFrame:
    """(package_id, document_id, signature): equal for documents whose non-blank pages agree in all that the exact shortcut compares."""
    one = F.struct("page_index", F.xxhash64("text_hash", "images.byte_sha256", form_values(F.col("form_fields")), annotation_set(F.col("annotations")), "has_signature_field", "has_signed_signature").alias("h"), "text_hash")
    listed = F.array_sort(F.collect_list(one))
    return pages.filter("not is_blank").groupBy("package_id", "document_id").agg(F.sha2(F.to_json(F.transform(listed, lambda x: F.struct(x["h"], x["text_hash"]))), 256).alias("signature"))


def blank_layout(pages: DataFrame) -> DataFrame:
    """(package_id, document_id, blanks): equal for documents that agree with their blank pages left in, given that the others do: the same
    number of pages, blank ones in the same places, and those equal in all that the exact shortcut compares."""
    own = F.xxhash64("text_hash", "images.byte_sha256", form_values(F.col("form_fields")), annotation_set(F.col("annotations")), "has_signature_field", "has_signed_signature")
    place = F.row_number().over(W.partitionBy("package_id", "document_id").orderBy("page_index"))
    listed = F.array_sort(F.collect_list(F.when(F.col("is_blank"), F.struct("place", "own"))))
    return pages.withColumns({"place": place, "own": own}).groupBy("package_id", "document_id").agg(F.to_json(F.struct(F.count("*").alias("pages"), listed.alias("blank"))).alias("blanks"))


def bucket_stats(docs: DataFrame, most: int = 50) -> DataFrame:
    """(package_id, bucket, members, pairs, capped) of buckets with two members or more."""
    n = with_bucket(docs).groupBy("package_id", "bucket").agg(F.count("*").alias("members")).filter("members > 1")
    return n.withColumn("pairs", (F.col("members") * (F.col("members") - 1) / 2).cast("long")).withColumn("capped", F.col("members") > most)


def candidate_pairs(docs: DataFrame, most: int = 50) -> DataFrame:
    """(package_id, a_id, b_id) in buckets of at most most members, a before b; larger buckets are grouped by signature instead.

    docs: fingerprints with traversal_index.
    """
    keyed = with_bucket(docs)
    sizes = keyed.groupBy("package_id", "bucket").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= most)).drop("n")
    small = keyed.join(sizes, ["package_id", "bucket"]).select("package_id", "bucket", "document_id", "traversal_index")
    a = small.withColumnsRenamed({"document_id": "a_id", "traversal_index": "ia"})
    b = small.withColumnsRenamed({"document_id": "b_id", "traversal_index": "ib"})
    return a.join(b, ["package_id", "bucket"]).filter("ia < ib").select("package_id", "a_id", "b_id", "ia", "ib")


def _marked(docs: DataFrame, pages: DataFrame | None) -> DataFrame:
    """docs with marks of the first (x), the last (y) and all (m) non-blank pages. Those of sketch.documents() have them; documents without such pages go."""
    if "m" in docs.columns:
        return docs.filter("x is not null")
    one = F.struct(*MARKS)
    made = marks(pages).groupBy("package_id", "document_id").agg(F.min_by(one, "ord").alias("x"), F.max_by(one, "ord").alias("y"), F.array_sort(F.collect_list(F.struct("ord", *MARKS))).alias("m"))
    return docs.join(made, ["package_id", "document_id"])


def _joined_pairs(docs: DataFrame, most: int) -> DataFrame:
    """candidate_pairs() with bound: what the marks of the first and the last page let the confidence be; n: how many pages each has."""
    met = candidate_pairs(docs, most)
    for side in ("a", "b"):
        met = met.join(docs.select("package_id", F.col("document_id").alias(f"{side}_id"), F.struct("x", "y", F.size("m").alias("n")).alias(side)), ["package_id", f"{side}_id"])
    bound = lambda at: alike_bound(lambda m: F.col(f"a.{at}.{m}"), lambda m: F.col(f"b.{at}.{m}"))
    return met.select("package_id", "a_id", "b_id", "ia", "ib", F.least(bound("x"), bound("y")).alias("bound"), F.col("a.n").alias("n"))


def _bounds(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """compare.alike_bound() of marks that broadcast with each other."""
    common = [np.zeros(np.broadcast(a["n"], b["n"]).shape, np.int32) for _ in range(2)]
    for lacks, x, y in ((common[0], a, b), (common[1], b, a)):
        for k in range(4):
            lacks -= np.bitwise_count(x[f"s{k}"] & ~y[f"s{k}"])
        lacks += x["n"]
    total = a["n"] + b["n"]
    bound = np.where(total == 0, 1.0, 2.0 * np.minimum(*common) / np.maximum(total, 1))
    return np.where(a["e"] == b["e"], 1.0, np.where(a["v"] == b["v"], bound, -1.0))


def _block_pairs(docs: DataFrame, most: int, floor: float) -> DataFrame:
    """_joined_pairs() of the buckets of more than most members, without pairs whose bound lies below floor.

    Documents of a bucket are dealt out in blocks of about BLOCK, each block with each, and every pair of them is looked at.
    """
    key = ["package_id", "bucket"]
    keyed = with_bucket(docs)
    large = keyed.groupBy(*key).agg(F.count("*").alias("members")).filter(F.col("members") > most).select(*key, F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    ends = [F.col(f"{at}.{m}").alias(f"{at}_{m}") for at in ("x", "y") for m in MARKS]
    held = keyed.join(F.broadcast(large), key).select(*key, "document_id", F.col("traversal_index").cast("long").alias("at"), F.size("m").alias("n"), *ends, "blocks", F.pmod(F.xxhash64("document_id"), F.col("blocks")).cast("int").alias("own"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("blocks", "own", "other")

    def compare(table: pa.Table) -> pa.Table:
        side, at, names = table["side"].to_numpy(), table["at"].to_numpy(), table["document_id"].to_pylist()
        one = table["i"][0] == table["j"][0]
        rows, cols = (np.arange(len(at)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        values = lambda name: table[name].to_numpy().view(np.uint64) if "_s" in name else table[name].to_numpy()
        ends = {e: {m: values(f"{e}_{m}") for m in MARKS} for e in ("x", "y")}
        take = lambda e, k: {m: v[k] for m, v in ends[e].items()}
        first, found, bounds = take("x", cols), [], []
        for lo in range(0, len(rows), 64):
            part = rows[lo : lo + 64]
            bound = _bounds({m: v[:, None] for m, v in take("x", part).items()}, {m: v[None, :] for m, v in first.items()})
            ok = bound >= floor - 1e-9
            if one:
                ok &= at[part][:, None] < at[cols][None, :]
            i, j = np.nonzero(ok)
            bound, i, j = bound[i, j], part[i], cols[j]
            bound = np.minimum(bound, _bounds(take("y", i), take("y", j)))
            ok = (bound >= floor - 1e-9) & (at[i] != at[j])
            i, j = i[ok], j[ok]
            early = at[i] < at[j]
            found.append(np.stack([np.where(early, i, j), np.where(early, j, i)]))
            bounds.append(bound[ok])
        a, b = np.concatenate(found, 1) if found else np.zeros((2, 0), int)
        ids = pa.array(names, pa.string())
        package = pa.array([table["package_id"][0].as_py()] * len(a), pa.string())
        return pa.table([package, ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(at[a].astype(np.int32)), pa.array(at[b].astype(np.int32)), pa.array(np.concatenate(bounds) if bounds else np.zeros(0)), table["n"].combine_chunks().take(pa.array(a))], names=["package_id", "a_id", "b_id", "ia", "ib", "bound", "n"])

    return dealt.groupBy(*key, "i", "j").applyInArrow(compare, "package_id string, a_id string, b_id string, ia int, ib int, bound double, n int")


def alike_pairs(docs: DataFrame, pages: DataFrame | None, most: int, floor: float) -> DataFrame:
    """(package_id, a_id, b_id, ia, ib, bound): all pairs in buckets of any size but those of which a page's marks tell that it is vetoed or less
    alike than floor: what is left out is neither same nor uncertain. bound is the most that the confidence can be.

    Buckets of at most most members meet by a join, larger ones in blocks. docs that sketch.documents() made have the marks; pages aren't looked at then.
    """
    marked = _marked(docs, pages)
    met = _joined_pairs(marked, most).filter(F.col("bound") >= floor - 1e-9).unionByName(_block_pairs(marked, most, floor)).checkpoint()
    both = met.filter("n > 2")  # of shorter ones all pages were looked at
    for side in ("a", "b"):
        both = both.join(marked.filter("size(m) > 2").select("package_id", F.col("document_id").alias(f"{side}_id"), F.col("m").alias(f"m{side}")), ["package_id", f"{side}_id"])
    pages_of_both = F.zip_with("ma", "mb", lambda x, y: alike_bound(lambda m: x[m], lambda m: y[m]))
    both = both.withColumn("bound", F.array_min(pages_of_both)).filter(F.col("bound") >= floor - 1e-9).select(*met.columns).checkpoint()
    return met.filter("n <= 2").unionByName(both).drop("n")


def compared_pairs(pairs: DataFrame, pages: DataFrame, floor: float = 0.80, same_at: float = 0.95) -> DataFrame:
    """Verdicts of pairs of documents with as many non-blank pages each, page by page in order. Only pages of documents in pairs are dealt out."""
    named = pairs.select("package_id", F.explode(F.array("a_id", "b_id")).alias("document_id")).distinct()
    body = of_documents(pages, named).select("package_id", "document_id", "ord", F.struct(*PAGE).alias("page"))
    left = pairs.join(body.withColumnsRenamed({"document_id": "a_id", "page": "a"}), ["package_id", "a_id"])
    both = left.join(body.withColumnsRenamed({"document_id": "b_id", "page": "b"}), ["package_id", "b_id", "ord"])
    verdicts = document_verdicts(compare_pages(both, floor), same_at, floor)
    return pairs.join(verdicts, ["package_id", "a_id", "b_id"])


def oversized_groups(docs: DataFrame, pages: DataFrame | None, most: int = 50) -> DataFrame:
    """(package_id, a_id, b_id, ia, ib): in buckets of more than most members, each document with the first of equal signature."""
    keyed = with_bucket(docs)
    large = keyed.groupBy("package_id", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > most).drop("n")
    signed = keyed.join(large, ["package_id", "bucket"])
    if "signature" not in docs.columns:
        signed = signed.join(signature_of_pages(pages), ["package_id", "document_id"])
    first = signed.groupBy("package_id", "bucket", "signature").agg(F.min_by("document_id", "traversal_index").alias("a_id"), F.min("traversal_index").alias("ia"))
    return signed.join(first, ["package_id", "bucket", "signature"]).filter("document_id <> a_id").select("package_id", "a_id", F.col("document_id").alias("b_id"), "ia", F.col("traversal_index").alias("ib"))


def canonical(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The document to keep of each group: no portfolio, signed if any, fewest blank pages, most text, first."""
    best = F.struct(F.col("is_portfolio_container"), ~F.col("has_signature_field"), F.col("blank_pages"), -F.col("text_length"), F.col("traversal_index"))
    return docs.groupBy(*keys).agg(F.min_by("document_id", best).alias("canonical_id"), F.count("*").alias("members"))


def _touched(pairs: DataFrame, sure: DataFrame, uncertain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(package_id, document_id) of sure and of all that stands in one of uncertain(pairs), of which only as many as needed are made: each document
    that isn't found yet tries its likeliest pairs, eight times as many each round, until it has one or none is left."""
    k = ["package_id", "document_id"]
    ends = lambda df: df.withColumn("document_id", F.explode(F.array("a_id", "b_id")))
    known, tried, most = sure.checkpoint(), 0, 1
    while True:
        wanted = ends(pairs).join(known, k, "left_anti")
        if most == 1:
            likeliest = F.max(F.struct("bound", (-F.col("ia")).alias("ia"), (-F.col("ib")).alias("ib"), "a_id", "b_id"))
            picked = wanted.groupBy(*k).agg(likeliest.alias("p")).select("package_id", "p.a_id", "p.b_id", (-F.col("p.ia")).alias("ia"), (-F.col("p.ib")).alias("ib"), "p.bound")
        else:
            nth = F.row_number().over(W.partitionBy(*k).orderBy(F.desc("bound"), "ia", "ib"))
            picked = wanted.withColumn("nth", nth).filter((F.col("nth") > tried) & (F.col("nth") <= most)).drop("nth", "document_id")
        picked = picked.distinct().checkpoint()
        if picked.isEmpty():
            return known
        known = known.unionByName(ends(uncertain(picked)).select(*k)).distinct().checkpoint()
        tried, most = most, 8 * most


def content_groups(docs: DataFrame, pages: DataFrame | None, most: int = 50, same_at: float = 0.95, uncertain_at: float = 0.80, texts: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """members: (package_id, document_id, component, canonical_id, method, confidence), uncertain: all pairs a person must look at.

    A member has method and confidence of its edge to the canonical document, else of the first edge that touches it; one that an
    uncertain pair touches needs review (shaky has these). Only pairs that may be the same are compared at once; the others when
    uncertain is looked at, of which shaky takes what it needs. docs: fingerprints with traversal_index and is_portfolio_container.
    texts: the non-blank pages of documents that it is given; then docs are of sketch.documents(), and pages aren't needed.
    """
    body = texts or non_blank(pages)
    met = alike_pairs(docs, body, most, min(same_at, uncertain_at))
    verdicts = compared_pairs(met.filter(F.col("bound") >= same_at - 1e-9).drop("bound"), body, uncertain_at, same_at).checkpoint()
    rest = met.filter(F.col("bound") < same_at - 1e-9)
    doubtful = lambda df: df.filter("verdict = 'uncertain'").select("package_id", "a_id", "b_id", "confidence", "ia", "ib")
    found = lambda df: doubtful(compared_pairs(df.drop("bound"), body, uncertain_at, same_at))
    blanks = docs.select("package_id", "document_id", "blanks") if texts else blank_layout(pages)
    edges = verdicts.filter("verdict = 'same'").join(blanks.withColumnsRenamed({"document_id": "a_id", "blanks": "ba"}), ["package_id", "a_id"]).join(blanks.withColumnsRenamed({"document_id": "b_id", "blanks": "bb"}), ["package_id", "b_id"])
    method = F.when(F.col("ba") != F.col("bb"), "blank_page_tolerant").when(F.col("all_hashes"), "normalized_pdf").otherwise("content_equivalent")
    edges = edges.select("package_id", "a_id", "b_id", "ia", "ib", method.alias("method"), "confidence").checkpoint()
    group = components(edges.select("package_id", F.col("a_id").alias("a"), F.col("b_id").alias("b"))).withColumnRenamed("id", "document_id")
    members = docs.join(group, ["package_id", "document_id"])
    best = canonical(members, ["package_id", "component"])
    touching = edges.select("package_id", F.col("a_id").alias("document_id"), F.col("b_id").alias("other"), "ia", "ib", "method", "confidence").unionByName(edges.select("package_id", F.col("b_id").alias("document_id"), F.col("a_id").alias("other"), "ia", "ib", "method", "confidence"))
    joined = members.select("package_id", "document_id", "component", "traversal_index").join(best, ["package_id", "component"])
    chosen = joined.join(touching, ["package_id", "document_id"]).groupBy("package_id", "document_id").agg(F.min_by(F.struct("method", "confidence"), F.struct(F.col("other") != F.col("canonical_id"), "ia", "ib")).alias("edge"))
    out = joined.join(chosen, ["package_id", "document_id"]).select("package_id", "document_id", "component", "canonical_id", "members", F.col("edge.method").alias("method"), F.col("edge.confidence").alias("confidence"), (F.col("document_id") != F.col("canonical_id")).alias("is_content_duplicate"))
    sure = doubtful(verdicts)
    shaky = _touched(rest, sure.select("package_id", F.explode(F.array("a_id", "b_id")).alias("document_id")).distinct(), found)
    return {"members": out, "uncertain": sure.unionByName(found(rest)), "shaky": shaky}
