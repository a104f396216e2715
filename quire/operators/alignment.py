"""Comparison of two packages, page by page.

Alignment, claims and the order of findings follow one another, so a package's pages go through one function; packages are independent
of each other. The words of two pages are only compared where their hashes differ and no veto tells them apart.
"""

from __future__ import annotations

import difflib
import json
import math
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.signals import UNDECODABLE
from quire.operators.compare import annotation_set, form_values

# Fixed values.
UNMATCHED = ["Meaningful Difference", "Likely Duplicate Removed", "Only in Old", "Only in New", "Possible Missing Document", "Extra Blank, Cover, Index, or Report Page"]
EXTRA_MARKERS = ["table of contents", "index", "cover page", "generated by", "processing report", "duplicate removal log", "this report"]
MEANINGFUL, EXTRA, MOVED, REMOVED, MISSING, ONLY_NEW = "Meaningful Difference", "Extra Blank, Cover, Index, or Report Page", "Moved or Reordered", "Likely Duplicate Removed", "Possible Missing Document", "Only in New"
MEANINGFUL_CHARS = 80
FINDINGS = "package_id string, finding_id string, category string, old_page int, new_page int, confidence double"


def is_extra_page() -> Column:
    """Blank, nearly empty without fields and images, or a cover, index or report."""
    t = F.col("normalized_text")
    marked = F.exists(F.array(*map(F.lit, EXTRA_MARKERS)), lambda m: F.contains(t, m))
    return F.col("is_blank") | ((F.length(t) < MEANINGFUL_CHARS) & (F.size("form_fields") == 0) & (F.size("images") == 0)) | marked


def side_pages(pages: DataFrame, side: str) -> DataFrame:
    """One side's pages in order of document and page, numbered from 0 through the package. pages: fingerprints with file_order."""
    order = W.partitionBy("package_id").orderBy("file_order", "page_index")
    one = pages.withColumns({"overall": F.row_number().over(order) - 1, "extra": is_extra_page(), "side": F.lit(side)})
    veto = F.sha2(F.to_json(F.struct("has_signature_field", "has_signed_signature", F.size("images").alias("n"), form_values(F.col("form_fields")).alias("f"), annotation_set(F.col("annotations")).alias("a"), "dates", "dollars", "names"), {"ignoreNullFields": "false"}), 256)
    return one.select("package_id", "side", "overall", "text_hash", "normalized_text", "extra", veto.alias("veto_key"), F.to_json("images", {"ignoreNullFields": "false"}).alias("images"))


SAME_AT, UNSURE_AT, EXACT_AT = 0.95, 0.80, 0.999
#: What is said of pages that no comparison decides.
EXTRA_CONFIDENCE, LONE_CONFIDENCE = 0.5, 0.3


@dataclass
class _Page:
    """One page as the alignment sees it; words and images are taken apart when first needed."""

    veto: str
    text_hash: str
    text: str
    raw_images: str
    extra: bool

    @cached_property
    def words(self) -> list[str]:
        return self.text.split()

    @cached_property
    def images(self) -> list[dict]:
        return json.loads(self.raw_images)

    @cached_property
    def bag(self) -> Counter:
        return Counter(self.words)


def _image_score(a: dict, b: dict) -> float:
    if a.get("byte_sha256") == b.get("byte_sha256"):
        return 1.0
    said = []
    p, q = a.get("perceptual_hash"), b.get("perceptual_hash")
    if p is not None and q is not None:
        said.append(1.0 - ((p ^ q) & (2**64 - 1)).bit_count() / 64)
    p, q = a.get("average_color"), b.get("average_color")
    if p is not None and q is not None:
        said.append(1.0 - math.dist([p[k] for k in "rgb"], [q[k] for k in "rgb"]) / math.sqrt(3 * 255**2))
    return min(said, default=UNDECODABLE)


def page_score(p: _Page, q: _Page, least: float = 0.0) -> float | None:
    """The confidence that two pages say the same; None if a protected difference tells them apart; 0 where a bound shows that least is out of reach."""
    if p.veto != q.veto:
        return None
    images = min((_image_score(a, b) for a, b in zip(p.images, q.images, strict=True)), default=1.0)
    if p.text_hash == q.text_hash or images < least:
        return images if images >= least else 0.0
    total = len(p.words) + len(q.words)
    if least and total and 2 * (p.bag & q.bag).total() / total < least:
        return 0.0
    return min(images, difflib.SequenceMatcher(None, p.words, q.words).ratio())


def band(confidence: float | None) -> str:
    """The category of two pages that stand in the same place."""
    if confidence is None or confidence < UNSURE_AT:
        return MEANINGFUL
    return "Exact Match" if confidence >= EXACT_AT else "Equivalent Content" if confidence >= SAME_AT else "Same Document, Different Version"


def _aligned(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of equal hashes match; replaced runs of one length are compared in place; every other page looks for its like among all unclaimed pages of the other side, old ones first."""
    fields = ["veto_key", "text_hash", "normalized_text", "images", "extra"]
    was, now = ([_Page(*r) for r in pdf[pdf["side"] == s].sort_values("overall")[fields].itertuples(index=False)] for s in ("old", "new"))
    found: list[tuple] = []
    loose: tuple[list[int], list[int]] = [], []
    matched_old: set[int] = set()
    matcher = difflib.SequenceMatcher(None, [p.text_hash for p in was], [p.text_hash for p in now], autojunk=False)
    for tag, i1, i2, j1, j2 in matcher.get_opcodes():
        if tag == "equal" or (tag == "replace" and i2 - i1 == j2 - j1):
            matched_old.update(range(i1, i2))
            for i, j in zip(range(i1, i2), range(j1, j2), strict=True):
                c = 1.0 if tag == "equal" else page_score(was[i], now[j])
                found.append((band(c), i, j, c or 0.0))
        else:
            loose[0].extend(range(i1, i2))
            loose[1].extend(range(j1, j2))

    free = dict.fromkeys(loose[0]), dict.fromkeys(loose[1])  # in order; what is claimed leaves
    for i in loose[0]:
        scored = [(c, -j) for j in free[1] if (c := page_score(was[i], now[j], SAME_AT)) is not None and c >= SAME_AT]
        if scored:
            c, j = max(scored)
            del free[1][-j], free[0][i]
            matched_old.add(i)
            found.append((MOVED, i, -j, c))
        elif was[i].extra:
            found.append((EXTRA, i, None, EXTRA_CONFIDENCE))
        else:
            like = (c for m in sorted(matched_old) if (c := page_score(was[i], was[m], SAME_AT)) is not None and c >= SAME_AT)
            c = next(like, None)
            found.append((MISSING, i, None, LONE_CONFIDENCE) if c is None else (REMOVED, i, None, c))
    for j in loose[1]:
        if j not in free[1]:
            continue
        scored = [(c, -i) for i in free[0] if (c := page_score(now[j], was[i], SAME_AT)) is not None and c >= SAME_AT]
        if scored:
            c, i = max(scored)
            del free[0][-i]
            found.append((MOVED, -i, j, c))
        else:
            found.append((EXTRA, None, j, EXTRA_CONFIDENCE) if now[j].extra else (ONLY_NEW, None, j, LONE_CONFIDENCE))
    rows = [(key[0], f"CMP-{k:04d}", c, i, j, s) for k, (c, i, j, s) in enumerate(found, 1)]
    rows.sort(key=lambda r: (10**9 if r[3] is None else r[3], r[4] or 0))
    out = pd.DataFrame(rows, columns=["package_id", "finding_id", "category", "old_page", "new_page", "confidence"])
    return out.astype({"old_page": "Int32", "new_page": "Int32", "confidence": "Float64"})


def compare_packages(old: DataFrame, new: DataFrame) -> DataFrame:
    """(package_id, finding_id, category, old_page, new_page, confidence) of two sides, pages from 0."""
    both = side_pages(old, "old").unionByName(side_pages(new, "new"))
    return both.groupBy("package_id").applyInPandas(_aligned, FINDINGS)


def ordered(findings: DataFrame) -> DataFrame:
    """In order of old page, then new page; what has no old page comes last."""
    return findings.orderBy("package_id", F.coalesce("old_page", F.lit(10**9)), F.coalesce("new_page", F.lit(0)))


def categories(findings: DataFrame) -> DataFrame:
    return findings.groupBy("package_id", "category").agg(F.count("*").alias("n")).withColumn("highlighted", F.col("category").isin(UNMATCHED))


def classified_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds role: original, final or other, by the file's name; Original is tried first."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    pdf = name.endswith(".pdf")
    return files.withColumn("role", F.when(pdf & name.contains("original lender package"), "original").when(pdf & name.contains("lender package"), "final").otherwise("other"))
