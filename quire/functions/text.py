"""Text functions. Those named exact_* need Python (Arrow batches); all others stay in the JVM."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Fixed values.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DATE = rf"(?i)\b(\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|(?:{MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}})\b"
DOLLAR = r"\$\s?[\d,]+(?:\.\d{2})?"
NAME = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
PAGE_TOTAL = r"page\s+\d+\s+of\s+(\d+)"
MAGIC = {"255044462D": "PDF", "504B0304": "ZIP", "D0CF11E0A1B11AE1": "OLE", "FFD8FF": "JPEG", "89504E470D0A1A0A": "PNG"}


def collapse(text: Column) -> Column:
    """White space, Unicode's too, as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Lower case, and ß as ss: case folding for what has no other special case."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal(text: Column) -> Column:
    return fold(collapse(text))


@F.pandas_udf(StringType())
def exact_collapse(text: pd.Series) -> pd.Series:
    """NFKC, then as collapse()."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(StringType())
def exact_normal(text: pd.Series) -> pd.Series:
    """NFKC and full case folding."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def _tokens(text: Column, pattern: str, group: int, may: Column) -> Column:
    """may: what holds wherever the pattern matches, and is sooner known."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))
    return F.when(text.isNull() | may, found).otherwise(F.array().cast("array<string>"))


def date_tokens(text: Column) -> Column:
    return _tokens(text, DATE, 1, text.rlike("[0-9]"))


def dollar_tokens(text: Column) -> Column:
    return _tokens(text, DOLLAR, 0, F.contains(text, F.lit("$")))


def name_tokens(text: Column) -> Column:
    return _tokens(text, NAME, 0, text.rlike(r"(?U)[A-Z][a-z]+\s+[A-Z][a-z]"))


def page_total(folded: Column) -> Column:
    """The total in the first "page x of y"; null without one."""
    found = F.regexp_extract(folded, PAGE_TOTAL, 1)
    return F.when(F.length(found).between(1, 9), found.cast("int"))


def is_garbled(text: Column) -> Column:
    """Long text that is nearly without white space."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    blanks = F.length(bare) - F.length(F.regexp_replace(bare, r"(?U)\s", ""))
    return (F.length(bare) >= 200) & (blanks / F.greatest(F.length(bare), F.lit(1)) < 0.03)


def disguised_kind(text: Column) -> Column:
    """What base64 text decodes to, if that begins like a known binary file; else null."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    fits = (F.length(bare) >= 200) & bare.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(bare) % 4 == 0)
    head = F.hex(F.unbase64(F.when(fits, F.left(bare, F.lit(24)))))
    kind = F.lit(None).cast("string")
    for magic, name in reversed(MAGIC.items()):
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    return kind


def wrapped(text: Column, width: int = 100) -> Column:
    """Lines cut hard at a width; a blank line is one blank."""
    def cut(line: Column) -> Column:
        pieces = F.greatest(F.lit(1), F.ceil(F.length(line) / width).cast("int"))
        return F.when(F.length(line) == 0, F.array(F.lit(" "))).otherwise(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.substring(line, i * width + 1, F.lit(width))))

    return F.flatten(F.transform(F.split(text, "\n", -1), cut))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, each with its lines joined by blanks."""
    blocks = F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n(?:[ \t]*\n)+", -1)
    lines = lambda b: F.filter(F.transform(F.split(b, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(blocks, lambda b: F.array_join(lines(b), " ")), lambda b: b != "")


def bag(items: Column) -> Column:
    """How many elements an array has, and the distinct ones as numbers."""
    return F.struct(F.size(items).alias("n"), F.array_distinct(F.transform(items, lambda v: F.xxhash64(v))).alias("d"))


def bag_bound(a: Column, b: Column) -> Column:
    """An upper bound of the sequence ratio of what two bags stand for: an element that the other lacks matches nothing."""
    both = F.size(F.array_intersect(a["d"], b["d"]))
    common = F.least(a["n"] - F.size(a["d"]) + both, b["n"] - F.size(b["d"]) + both)
    return F.when(a["n"] + b["n"] == 0, 1.0).otherwise(2.0 * common / F.greatest(a["n"] + b["n"], F.lit(1)))


def char_counts(text: Column, buckets: int = 32) -> Column:
    """How many characters fall into each of a few buckets."""
    chars = F.array_distinct(F.split(text, ""))
    counted = F.transform(chars, lambda c: F.struct(F.pmod(F.xxhash64(c), F.lit(buckets)).alias("b"), F.when(c == "", 0).otherwise(F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("n")))
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.aggregate(counted, F.lit(0), lambda n, x: n + F.when(x["b"] == b, x["n"]).otherwise(0)))


def counts_bound(a: Column, b: Column) -> Column:
    """As bag_bound(), of two results of char_counts()."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, v: n + v)
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, v: n + v)
    return F.when(total(a) + total(b) == 0, 1.0).otherwise(2.0 * common / F.greatest(total(a) + total(b), F.lit(1)))


def _ratio(a, b) -> float:
    return 1.0 if not a and not b else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def word_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The matching-blocks ratio of the words of two texts, frequent words of a long second text being no anchors. Not symmetric."""
    for a, b in pairs:
        yield pd.Series([_ratio((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def char_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The matching-blocks ratio of the characters of two texts."""
    for a, b in pairs:
        yield pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def pretty_xml(text: pd.Series) -> pd.Series:
    """XML indented by two blanks; anything else as it is."""
    from xml.dom import minidom
    from xml.parsers.expat import ExpatError

    def one(t: str | None) -> str | None:
        if t is None or not t.lstrip().startswith("<?xml"):
            return t
        try:
            return "\n".join(x for x in minidom.parseString(t.encode()).toprettyxml(indent="  ").splitlines() if x.strip())
        except ExpatError:
            return t

    return text.map(one)
