"""Rules that locate known kinds of documents by the words on their pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T

# Fixed values.
CONFIDENCE = {"Confirmed": 1.0, "Strong Match": 0.75, "Possible Match": 0.4}
EXTRACTED = ["Confirmed", "Strong Match"]
CATEGORIES = ["closing_disclosure", "loan_estimate", "alta_settlement_statement", "government_id", "mu_privacy_policy", "mu_ma_broker_addendum", "non_proceeding"]
CD_TITLE = "closing disclosure"
CD_SECTIONS = ["closing information", "transaction information", "loan information", "loan terms", "projected payments", "loan costs", "loan calculations", "cash to close", "calculating cash to close"]
CD_REVISED = ["revised", "corrected"]
CD_PAGES, LE_PAGES = 5, 3
LE_TITLE = "loan estimate"
LE_CAPTION = "compare with your closing disclosure"
LE_SECTIONS = ["loan terms", "projected payments", "costs at closing", "closing cost details", "calculating cash to close", "comparisons", "other considerations", "confirm receipt"]
ALTA_TITLES = ["alta settlement statement", "alta combined settlement statement"]
ALTA_BYLINE = "american land title association"
ALTA_SECTIONS = ["prorations/adjustments", "loan charges to", "financial"]
ALTA_SIDES = {"combined": "Combined", "seller": "Seller", "buyer": "Buyer"}
DRIVER_LICENSE = ["driver license", "driver's license", "drivers license", "operator license", "commercial driver license"]
STATE_ID = ["state identification card", "state id card"]
PASSPORT = ["passport"]
ID_FIELDS = ["dob", "date of birth", "class", "hgt", "eyes", "rstr", "endorsements", "issued", "expires"]
ID_BACK = ["barcode", "pdf417", "organ donor", "reverse side"]
PRIVACY_TITLE = "do with your personal information"
PRIVACY_SECTIONS = ["facts", "who we are", "reasons we can share", "what we do"]
ADDENDUM_TITLE = "addendum to uniform residential loan application"
ADDENDUM_STATE = "massachusetts"
ADDENDUM_SECTIONS = ["attorney disclosure", "broker license disclosure"]
NON_PROCEEDING = {
    "Adverse Action Notice": ["adverse action notice", "statement of credit denial"],
    "Withdrawal Certification": ["withdrawal certification", "application withdrawal", "withdrawn loan certification"],
    "Denial Notice": ["notice of denial", "loan denial notice", "your loan has been denied"],
    "Cancellation Notice": ["loan has been cancelled", "loan has been canceled", "application has been cancelled", "application has been canceled", "cancellation of your loan", "cancellation of your application"],
    "Closed for Incompleteness": ["closed for incompleteness", "file closed due to incomplete", "incomplete application"],
}
OTHER_NON_PROCEEDING = ["will not proceed", "unable to proceed with your loan", "loan will not close", "application has been withdrawn"]
OTHER_NAME = "Other Non-Proceeding Document"

KEY = ["package_id", "document_id"]


def _any(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])


def _count(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(m).cast("int") for m in markers])


def islands(hits: DataFrame, max_gap: int, keys: list[str], at: str = "page_index") -> DataFrame:
    """(keys, start, end): runs of hits that miss at most max_gap places in between."""
    order = W.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(order) <= max_gap + 1, 0).otherwise(1)
    numbered = hits.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("_run")


def _ranges(pages: DataFrame, marker: Column, measures: dict[str, Column]) -> DataFrame:
    """A row a run of marked pages (one missing page is bridged), with measures over all pages from its start to its end."""
    runs = islands(pages.filter(marker).select(*KEY, "page_index"), 1, KEY)
    inside = pages.join(runs, KEY).filter("page_index between start and end")
    return inside.groupBy(*KEY, "start", "end").agg(*[v.alias(k) for k, v in measures.items()])


def _sections(text: Column, markers: list[str]) -> Column:
    """How many of the markers stand on any page of the group."""
    return reduce(lambda a, b: a + b, [F.max(text.contains(m)).cast("int") for m in markers])


def _signature(signed: Column, inked: Column, images: Column) -> Column:
    return F.when(signed, "E-Sign").when(inked, "Signed").when(images, "Signature Unknown").otherwise("Unsigned")


def _row(df: DataFrame, category: str, band: Column, subtype: Column, signature: Column, person: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c
    return df.select(*KEY, F.lit(category).alias("category"), pick(subtype).alias("subtype"), band.alias("confidence_band"), (F.col("start") + 1).alias("first_page"), (F.col("end") + 1).alias("last_page"), pick(signature).alias("signature_status"), pick(person).alias("person_name"))


def _one_page(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"start": F.col("page_index"), "end": F.col("page_index")})


def find_key_documents(pages: DataFrame, company: str = "") -> DataFrame:
    """A row a match, pages from 1. pages: page fingerprints (normalized_text, images, annotations, names, has_signed_signature).

    company: the marker that a company's own privacy notice and addendum must carry; without one neither is looked for. Markers are
    substrings, not words.
    """
    t = F.col("normalized_text")
    df = pages.withColumn("total", T.page_total(t))
    total, images = F.coalesce(F.col("total"), F.lit(0)), F.size("images")
    ink = F.exists("annotations", lambda a: (a["subtype"] == "/Ink") & F.coalesce(a["has_appearance_stream"], F.lit(False)))

    cd = _ranges(df, t.contains(CD_TITLE) & (total != LE_PAGES) & ~t.contains(LE_CAPTION), {
        "sections": _sections(t, CD_SECTIONS), "footer": F.max(total == CD_PAGES), "revised": F.max(_any(t, CD_REVISED)),
        "signed": F.max("has_signed_signature"), "inked": F.max(ink), "pictured": F.max(images > 0)})
    footer_band = F.when(F.col("footer") & (F.col("sections") >= 2), "Confirmed").when(F.col("footer"), "Strong Match").otherwise("Possible Match")
    found = [_row(cd, CATEGORIES[0], footer_band, None, F.when(F.col("revised"), "Revised").otherwise(_signature(F.col("signed"), F.col("inked"), F.col("pictured"))), None)]

    le = _ranges(df, t.contains(LE_TITLE) & (total != CD_PAGES), {"sections": _sections(t, LE_SECTIONS), "footer": F.max(total == LE_PAGES)})
    found.append(_row(le, CATEGORIES[1], footer_band, None, None, None))

    sides = {f"side{j}": F.max(t.contains(m)) for j, m in enumerate(ALTA_SIDES)}
    alta = _ranges(df, _any(t, ALTA_TITLES), {"sections": _sections(t, ALTA_SECTIONS), "byline": F.max(t.contains(ALTA_BYLINE))} | sides)
    band = F.when(F.col("byline") & (F.col("sections") >= 2), "Confirmed").when(F.col("byline") | (F.col("sections") >= 2), "Strong Match").otherwise("Possible Match")
    side = F.coalesce(*[F.when(F.col(f"side{j}"), name) for j, name in enumerate(ALTA_SIDES.values())])
    found.append(_row(alta, CATEGORIES[2], band, side, None, None))

    kind = F.when(_any(t, DRIVER_LICENSE), "Driver's License").when(_any(t, STATE_ID), "State ID Card").when(_any(t, PASSPORT), "Passport")
    ids = _one_page(df.filter(images > 0).withColumns({"kind": kind, "fields": _count(t, ID_FIELDS)}).filter("kind is not null or fields >= 3"))
    band = F.when(F.col("kind").isNotNull() & (F.col("fields") >= 2), "Confirmed").when(F.col("kind").isNotNull(), "Strong Match").otherwise("Possible Match")
    face = F.when(_any(t, ID_BACK), "Back").when(images >= 2, "Front and Back").otherwise("Front")
    subtype = F.when(F.col("kind") == "Driver's License", F.concat(F.lit("Drivers License "), face)).otherwise(F.coalesce("kind", F.lit("Unknown Government ID Side")))
    found.append(_row(ids, CATEGORIES[3], band, subtype, None, F.get("names", F.lit(0))))

    if company:
        own = _one_page(df.filter(t.contains(company.casefold())))
        privacy = own.filter(t.contains(PRIVACY_TITLE))
        found.append(_row(privacy, CATEGORIES[4], F.when(_count(t, PRIVACY_SECTIONS) >= 2, "Confirmed").otherwise("Strong Match"), None, None, None))
        addendum = own.filter(t.contains(ADDENDUM_TITLE) & t.contains(ADDENDUM_STATE))
        found.append(_row(addendum, CATEGORIES[5], F.when(_count(t, ADDENDUM_SECTIONS) >= 1, "Confirmed").otherwise("Strong Match"), None, None, None))

    named = F.coalesce(*[F.when(_any(t, markers), name) for name, markers in NON_PROCEEDING.items()])
    stopped = _one_page(df.withColumn("sub", F.coalesce(named, F.when(_any(t, OTHER_NON_PROCEEDING), OTHER_NAME))).filter("sub is not null"))
    found.append(_row(stopped, CATEGORIES[6], F.when(F.col("sub") == OTHER_NAME, "Possible Match").otherwise("Confirmed"), F.col("sub"), None, None))

    confidence = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    order = F.create_map(*[F.lit(x) for j, c in enumerate(CATEGORIES) for x in (c, j)])
    out = reduce(DataFrame.unionByName, found)
    return out.withColumns({"confidence": F.element_at(confidence, F.col("confidence_band")), "category_order": F.element_at(order, F.col("category")), "extract": F.col("confidence_band").isin(EXTRACTED)})


def numbered(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds match_id KD-0001... in order of document, detector and page; docs: (package_id, document_id, traversal_index)."""
    order = W.partitionBy("package_id").orderBy("traversal_index", "category_order", "first_page")
    return matches.join(docs, KEY).withColumn("match_id", F.format_string("KD-%04d", F.row_number().over(order)))


def located(matches: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds the pages of each match in its part and in the whole package; placed: packing.offsets()."""
    spots = placed.select(*KEY, "part", "offset_in_part", "offset_overall")
    add = lambda base, c: F.col(base) + F.col(c)
    return matches.join(spots, KEY, "left").withColumns({
        "part_first": add("offset_in_part", "first_page"), "part_last": add("offset_in_part", "last_page"),
        "overall_first": add("offset_overall", "first_page"), "overall_last": add("offset_overall", "last_page")})
