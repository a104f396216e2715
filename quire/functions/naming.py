"""Names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ARTIFACTS = [".ds_store", "thumbs.db", "desktop.ini"]
ARCHIVE_METADATA = "__macosx"
BLOCKED = "BLOCKED_UNSAFE_PATH"
FINAL_KIND, ORIGINAL_KIND = "Lender Package", "Original Lender Package"
FOLDER = r"^([^,]+?)\s*,\s*([^,]+?)(?:\s*,\s*([^,]+?))?\s*$"


def segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), lambda x: x != "")


def is_artifact(path: Column) -> Column:
    """Metadata of operating systems and archivers."""
    parts = F.transform(segments(path), F.lower)
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return base.isin(ARTIFACTS) | F.exists(parts, lambda x: x == ARCHIVE_METADATA)


def safe_path(path: Column) -> Column:
    """A relative path without empty and dot parts; an absolute one, one with a drive or with .. is blocked under its last part."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    kept = F.filter(F.split(plain, "/", -1), lambda x: ~x.isin("", "."))
    bad = plain.startswith("/") | (F.substring(plain, 2, 1) == ":") | F.exists(kept, lambda x: x == "..") | (F.size(kept) == 0)
    name = F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("unnamed_entry"))
    return F.when(bad, F.concat(F.lit(f"{BLOCKED}/"), name)).otherwise(F.array_join(kept, "/"))


def sanitized(value: Column) -> Column:
    """What any file system can hold: none of <>:"/\\|?* and control characters, single blanks, no blank or dot at the ends."""
    bare = F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]', ""), r"(?U)\s+", " ")
    return F.regexp_replace(bare, r"^[ .]+|[ .]+$", "")


def natural_key(name: Column) -> Column:
    """A key under which runs of digits sort as numbers and the rest without case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("\x01"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 24, "0"))).otherwise(p))
    return F.array_join(numbers, "\x02")


def joined(*parts: Column) -> Column:
    """The parts that aren't empty, with commas."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", ")


def borrower(last: Column, first: Column) -> Column:
    return joined(sanitized(last), sanitized(first))


def folder_name(last: Column, first: Column, adverse: Column, lender: Column, loan: Column) -> Column:
    name = joined(sanitized(last), sanitized(first), F.when(adverse, "Adverse"), sanitized(lender), sanitized(loan))
    return F.when(name == "", FINAL_KIND).otherwise(name)


def part_filename(last: Column, first: Column, kind: Column, lender: Column, loan: Column, part: Column, parts: Column) -> Column:
    base = joined(borrower(last, first), kind, sanitized(lender), sanitized(loan))
    return F.concat(sanitized(F.when(parts > 1, F.concat(base, F.format_string(", Part %03d", part))).otherwise(base)), F.lit(".pdf"))


def identity(folder: Column) -> tuple[Column, Column, Column]:
    """Last name, first name and loan number of a folder's name; all of it is the last name if it isn't of that form."""
    name = F.trim(folder)
    fits = name.rlike(FOLDER)
    pick = lambda k: F.trim(F.regexp_extract(name, FOLDER, k))
    return F.when(fits, pick(1)).otherwise(name), F.when(fits, pick(2)).otherwise(""), F.when(fits, pick(3)).otherwise("")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^./\\]+)$", 1))


def shortened(path: Column, most: int = 200, least: int = 20) -> Column:
    """A path of limited length that keeps a short extension."""
    ext = F.regexp_extract(path, r"(\.[^./\\]{1,9})$", 1)
    room = F.greatest(F.lit(least), F.lit(most) - F.length(ext))
    stem = F.left(path, F.length(path) - F.length(ext))
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.rtrim(F.left(stem, room)), ext))


def with_copy_number(name: Column, copy: Column, form: str = " (%d)") -> Column:
    """The name for the copy-th time it is needed: form before the extension from the second on."""
    ext = F.regexp_extract(name, r"(\.[^./\\]+)$", 1)
    stem = F.left(name, F.length(name) - F.length(ext))
    return F.when(copy <= 1, name).otherwise(F.concat(stem, F.format_string(form, copy), ext))


def output_folder(last: Column, first: Column, adverse: Column, lender: Column, loan: Column, source: Column, at: Column) -> Column:
    """The folder of a run: named after the borrower or, if nobody is named, after the source (a name without its extension) and the time."""
    known = F.exists(F.array(last, first, loan), lambda x: F.coalesce(x, F.lit("")) != "")
    tail = F.concat(F.lit("_Lender_Package_Output_"), F.date_format(at, "yyyyMMdd_HHmmss"))
    stem = F.regexp_replace(source, r"(?<=.)\.[^./\\]+$", "")
    return F.when(known, shortened(folder_name(last, first, adverse, lender, loan))).otherwise(F.concat(shortened(stem, 160), tail))


def unconverted_path(path: Column) -> Column:
    """Where the original of a file without conversion is kept: each part of its path is short, empty ones go."""
    return F.coalesce(F.nullif(F.array_join(F.transform(segments(path), lambda p: shortened(p)), "/"), F.lit("")), F.lit("unnamed"))


def with_id(path: Column, document_id: Column) -> Column:
    """A path with the document's id before its extension."""
    ext = F.regexp_extract(path, r"[^/](\.[^./\\]+)$", 1)
    return F.concat(F.left(path, F.length(path) - F.length(ext)), F.lit("_"), document_id, ext)
