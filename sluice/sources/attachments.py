"""Text of attachments: plain text, XLSX, DOCX and ZIP by the standard library; kinds without a reader give an error, never an exception.

Packages are read part by part with incremental XML parsing, and no part is inflated beyond PART_BYTES, so that a small file that
unpacks into a huge one can't exhaust a worker. A ZIP gives a row with its listing and a row for each member of a kind that can
be read, up to the limits.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Fixed limits.
LARGE_BYTES, OVERSIZE_BYTES = 50 << 20, 200 << 20
ZIP_MEMBERS, ZIP_BYTES, ZIP_LISTED = 25, 200 << 20, 1000
SHEETS, ROWS = 5, 500
PART_BYTES = 64 << 20  # of one part of a package
OUT = "sha256 string, filename string, member string, text string, flags array<string>, error string"
TEXTS, PACKAGES = (".txt", ".csv", ".md"), (".pdf", ".docx", ".xlsx")
_BAD = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, OSError, EOFError, RuntimeError, NotImplementedError, zlib.error)  # encrypted and unknown members too


class _Bounded(io.RawIOBase):
    """A part of a package that ends with an error beyond PART_BYTES."""

    def __init__(self, part):
        self.part, self.left = part, PART_BYTES

    def read(self, n: int = -1) -> bytes:
        got = self.part.read(self.left + 1 if n < 0 else n)
        self.left -= len(got)
        if self.left < 0:
            raise ValueError("part too large")
        return got


def _elements(z: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a part whose local name it is, one after the other; each is emptied once it has been looked at."""
    with z.open(part) as f:
        for _, e in ElementTree.iterparse(_Bounded(f)):
            if e.tag.rpartition("}")[2] == name:
                yield e
                e.clear()


def _text_of(e: ElementTree.Element, leaf: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if x.tag.rpartition("}")[2] == leaf)


def _cell(c: ElementTree.Element, strings: list[str]) -> str:
    """A cell's value: an index of the shared strings (type s), its own string (inlineStr), or what stands in v."""
    kind = c.get("t")
    if kind == "inlineStr":
        return _text_of(c)
    value = _text_of(c, "v")
    if kind == "s":
        return strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
    return value


def xlsx_text(data: bytes) -> tuple[str, list[str]]:
    """(a line for each row with a value, cells apart by tabs; flags) of the first SHEETS sheets' first ROWS rows."""
    lines, flags = [], set()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = z.namelist()
        strings = [_text_of(e) for e in _elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in parts else []
        sheets = sorted((p for p in parts if re.fullmatch(r"xl/worksheets/[^/]+\.xml", p)), key=lambda p: (len(p), p))
        if len(sheets) > SHEETS:
            flags.add("sheets_truncated")
        for sheet in sheets[:SHEETS]:
            rows = _elements(z, sheet, "row")
            for row in islice(rows, ROWS):
                cells = [_cell(c, strings) for c in row if c.tag.rpartition("}")[2] == "c"]
                if any(cells):
                    lines.append("\t".join(cells))
            if next(rows, None) is not None:
                flags.add("rows_truncated")
    return "\n".join(lines), sorted(flags)


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(_text_of(p) for p in _elements(z, "word/document.xml", "p"))


def zip_rows(data: bytes, flags: list[str]) -> list[tuple]:
    """The listing of a ZIP as a row, and the rows of its members that can be read."""
    flags, rows, budget, opened = set(flags), [], ZIP_BYTES, 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        entries = [e for e in z.infolist() if not e.is_dir()]
        listing = "\n".join(e.filename for e in entries[:ZIP_LISTED])
        if len(entries) > ZIP_LISTED:
            flags.add("zip_listing_truncated")
        for e in entries:
            if not e.filename.lower().endswith(TEXTS + PACKAGES):
                continue
            if opened == ZIP_MEMBERS:
                flags.add("zip_truncated")
                break
            opened += 1
            try:
                with z.open(e) as f:
                    content = f.read(budget + 1)
            except _BAD as bad:
                rows.append((e.filename, None, [], _error(bad)))
                continue
            if len(content) > budget:
                flags.add("zip_truncated")
                break
            budget -= len(content)
            rows += [(e.filename, text, more, error) for _, text, more, error in extract(e.filename, content, 1)]
    return [(None, listing, sorted(flags), None), *rows]


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:400]


def extract(filename: str, data: bytes, depth: int = 0) -> list[tuple[str | None, str | None, list[str], str | None]]:
    """(member, text, flags, error) of an attachment, and of a ZIP's members."""
    if len(data) > OVERSIZE_BYTES:
        return [(None, None, ["oversize"], None)]
    flags = ["large"] if len(data) > LARGE_BYTES else []
    low = filename.lower()
    try:
        if low.endswith(TEXTS):
            return [(None, data.decode("utf-8", "replace"), flags, None)]
        if low.endswith(".xlsx"):
            text, more = xlsx_text(data)
            return [(None, text, flags + more, None)]
        if low.endswith(".docx"):
            return [(None, docx_text(data), flags, None)]
        if low.endswith(".zip") and depth == 0:
            return zip_rows(data, flags)
    except _BAD as e:
        return [(None, None, flags, _error(e))]
    return [(None, None, flags, "unsupported")]


def extract_texts(files: DataFrame) -> DataFrame:
    """sha256, filename, data -> texts. Equal contents are read once if the caller drops their copies first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(sha, name, *r) for sha, name, data in zip(batch["sha256"], batch["filename"], batch["data"]) for r in extract(name or "", bytes(data or b""))]
            yield pd.DataFrame(rows, columns=["sha256", "filename", "member", "text", "flags", "error"])

    return files.select("sha256", "filename", "data").mapInPandas(run, OUT)
