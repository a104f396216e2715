"""Files to page records, with the standard library only. A file that can't be decoded is one placeholder page, never an error.

PDF, raster images and legacy office files need an external page extractor: their page records are read, not made here.
"""

from __future__ import annotations

import email
import email.policy
import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Fixed values.
TEXT = {".txt", ".log", ".csv", ".md", ".xml"}
HTML = {".html", ".htm"}
EMAIL = {".eml"}
WORD, SHEET = {".docx"}, {".xlsx"}
SUPPORTED = sorted(TEXT | HTML | EMAIL | WORD | SHEET)
ENCODINGS = ["utf-8-sig", "utf-8", "cp1252", "latin-1"]
WIDTH, LINES, MAX_ROWS = 100, 60, 2000
SKIPPED = {"script", "style", "head", "title", "noscript"}
BLOCKS = {"p", "div", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article", "dt", "dd", "caption", "figcaption"}
PAGES = "package_id string, document_id string, page_index int, raw_text string, status string, backend string, error string"


def decode_text(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


class _Blocks(HTMLParser):
    """The texts of innermost block elements, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.now = 0, []

    def _close(self) -> None:
        if text := " ".join("".join(self.now).split()):
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in SKIPPED
        if tag in BLOCKS:
            self._close()
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self.skip = max(0, self.skip - (tag in SKIPPED))
        if tag in BLOCKS:
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.now.append(data)


def html_blocks(text: str) -> list[str]:
    parser = _Blocks()
    parser.feed(text)
    parser.close()
    parser._close()
    return parser.out


def wrap(text: str) -> list[str]:
    out: list[str] = []
    for line in text.replace("\r\n", "\n").split("\n"):
        out += [line[i : i + WIDTH] for i in range(0, len(line), WIDTH)] if line else [" "]
    return out


def as_pages(lines: list[str]) -> list[str]:
    return ["\n".join(lines[i : i + LINES]) for i in range(0, len(lines), LINES)] or [""]


def _word(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith("}p")]


def _sheet(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter() if t.tag.endswith("}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if s.tag.endswith("}si")]
        out: list[str] = []
        for name in sorted(n for n in names if n.startswith("xl/worksheets/sheet")):
            rows = [r for r in ElementTree.fromstring(z.read(name)).iter() if r.tag.endswith("}row")]
            for row in rows[:MAX_ROWS]:
                cells = []
                for c in (c for c in row if c.tag.endswith("}c")):
                    text = "".join(v.text or "" for v in c.iter() if v.tag.endswith("}v") or v.tag.endswith("}t"))
                    cells.append(shared[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text)
                out.append("\t".join(cells))
    return out


def _email(data: bytes, depth: int) -> list[str]:
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{k}: {message.get(k, '')}" for k in ("From", "To", "Cc", "Date", "Subject") if message.get(k)]
    body = message.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body is not None else ""
    if body is not None and body.get_content_type() == "text/html":
        text = "\n".join(html_blocks(text))
    pages = as_pages([*head, " ", *wrap(text)])
    for part in message.iter_attachments():
        name = part.get_filename() or "attachment"
        content = part.get_content()
        raw = content.encode() if isinstance(content, str) else content.as_bytes() if hasattr(content, "as_bytes") else bytes(content)
        pages.append(f"Attachment: {name}")
        pages += pages_of(name, raw, depth + 1)[0]
    return pages


def pages_of(name: str, data: bytes, depth: int = 0) -> tuple[list[str], str, str, str | None]:
    """(pages, status, backend, error)."""
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if ext in TEXT:
            return as_pages(wrap(decode_text(data))), "converted", "text", None
        if ext in HTML:
            return as_pages([x for b in html_blocks(decode_text(data)) for x in wrap(b)]), "converted", "html", None
        if ext in EMAIL and depth < 10:
            return _email(data, depth), "converted", "email", None
        if ext in WORD:
            return as_pages([x for p in _word(data) for x in wrap(p)]), "converted", "docx", None
        if ext in SHEET:
            return as_pages(_sheet(data)), "converted", "xlsx", None
        problem = f"no decoder for {ext or 'a name without extension'}"
    except Exception as error:  # any malformed file is a placeholder
        problem = f"{type(error).__name__}: {error}"
    return [f"Could not be converted: {name}\n{problem}"], "unconverted_placeholder", "placeholder", problem


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            pages, status, backend, error = pages_of(r.original_filename or "", bytes(r.content or b""))
            rows += [(r.package_id, r.document_id, i, p, status, backend, error) for i, p in enumerate(pages)]
        yield pd.DataFrame(rows, columns=["package_id", "document_id", "page_index", "raw_text", "status", "backend", "error"]).astype({"page_index": "int32"})


def decode_files(files: DataFrame) -> DataFrame:
    """Page records of (package_id, document_id, original_filename, content)."""
    return files.select("package_id", "document_id", "original_filename", "content").mapInPandas(_decoded, PAGES)


@F.pandas_udf(ArrayType(StringType()))
def blocks_of_html(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [] if h is None else html_blocks(h))


def backend_counts(pages: DataFrame) -> DataFrame:
    return pages.filter("page_index = 0").groupBy("package_id", "backend").agg(F.count("*").alias("documents"))
