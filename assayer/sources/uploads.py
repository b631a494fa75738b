"""Upload validation and identity as columns, and the parsers of the file formats."""

from __future__ import annotations

import csv
import io
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import BATCH_BYTES, small_batches

# Formats taken, and limits.
EXTENSIONS = [".csv", ".docx", ".md", ".pdf", ".txt"]
TEXT_EXTENSIONS = [".csv", ".md", ".txt"]
NAME_CHARS = 160
NUL_BYTES_LOOKED_AT = 8192
CSV_ROWS = 10_000
DOCX_BYTES = 50 * 1024 * 1024


def sanitize_filename(c: Column) -> Column:
    """The last path part; runs of other characters than letters, digits and '._ -' become '_'."""
    path = F.regexp_replace(F.translate(c, "\\", "/"), r"(?:/\.?)+$", "")
    name = F.trim(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._ -]+", "_"), 1, NAME_CHARS), F.lit("")), F.lit("document"))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\A.+(\.[^.]+)\z", 1))


def upload_error(name: Column, content: Column, max_bytes: int) -> Column:
    """Why an upload is refused (null: it isn't): unsupported_type, empty, too_large, binary_text."""
    ext = extension(sanitize_filename(name))
    nul = F.position(F.lit(b"\x00"), F.substring(content, 1, NUL_BYTES_LOOKED_AT)) > 0
    return (
        F.when(~ext.isin(EXTENSIONS), "unsupported_type").when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty")
        .when(F.length(content) > max_bytes, "too_large").when(ext.isin(TEXT_EXTENSIONS) & nul, "binary_text")
    )


def document_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def guard_formula(c: Column) -> Column:
    """An apostrophe before what a spreadsheet would run."""
    return F.when(c.rlike(r"(?U)\A[\s\x1c-\x1f]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def decode_text(raw: bytes) -> str:
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")


def normalized(text: str) -> str:
    """As functions.text.normalize_text, for parsed pages."""
    lines = [" ".join(x.translate(_BLANKS).split(" ")) for x in unicodedata.normalize("NFKC", text.replace("\x00", "")).splitlines()]
    out: list[str] = []
    for x in lines:
        x = " ".join(p for p in x.split(" ") if p).strip()
        if x or out[-2:] != ["", ""][: len(out[-2:])] or not out:
            out.append(x)
    joined = "\n".join(out)
    while "\n\n\n" in joined:
        joined = joined.replace("\n\n\n", "\n\n")
    return joined.strip()


_BLANKS = str.maketrans({c: " " for c in "\t\x0b\x0c\r"})


def csv_text(raw: bytes) -> str:
    """Rows as 'Row n: a | b', with formula cells made harmless."""
    text = decode_text(raw)
    try:
        dialect = csv.Sniffer().sniff(text[:NUL_BYTES_LOOKED_AT], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    out = []
    for n, row in enumerate(csv.reader(io.StringIO(text), dialect), 1):
        if n > CSV_ROWS:
            raise ValueError("too many rows")
        cells = (x.strip() for x in row)
        out.append(f"Row {n}: " + " | ".join("'" + x if x.startswith(("=", "+", "-", "@")) else x for x in cells))
    return "\n".join(out)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _said(node: ElementTree.Element) -> str:
    """A paragraph's text: runs, tabs and breaks."""
    return "".join({f"{_W}t": x.text or "", f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}.get(x.tag, "") for x in node.iter())


def docx_text(raw: bytes) -> str:
    """Paragraphs, then the tables' rows with cells joined by ' | '."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if sum(i.file_size for i in z.infolist()) > DOCX_BYTES:
                raise ValueError("expands too far")
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError("not a DOCX file") from e
    if body is None:
        return ""
    blocks = [t for p in body.findall(f"{_W}p") if (t := _said(p)).strip()]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        blocks.append(" | ".join("\n".join(_said(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")))
    return "\n\n".join(blocks)


def pdf_pages(raw: bytes, max_pages: int) -> list[str]:
    """Text by page; needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    try:
        reader = PdfReader(io.BytesIO(raw), strict=False)
        if reader.is_encrypted:
            raise ValueError("encrypted")
        if len(reader.pages) > max_pages:
            raise ValueError("too many pages")
        return [p.extract_text() or "" for p in reader.pages]
    except ValueError:
        raise
    except Exception as e:  # the package raises many kinds
        raise ValueError("not a PDF file") from e


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A DOCX file of plain paragraphs."""
    root = ElementTree.Element(f"{_W}document")
    body = ElementTree.SubElement(root, f"{_W}body")
    for p in paragraphs:
        ElementTree.SubElement(ElementTree.SubElement(ElementTree.SubElement(body, f"{_W}p"), f"{_W}r"), f"{_W}t").text = p
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(root, "utf-8"))
    return out.getvalue()


def parse_file(raw: bytes, ext: str, max_pages: int) -> tuple[list[tuple[int, str]], list[str]]:
    """Pages with text (number and text), and warnings."""
    pages = pdf_pages(raw, max_pages) if ext == ".pdf" else [docx_text(raw) if ext == ".docx" else csv_text(raw) if ext == ".csv" else decode_text(raw)]
    texts = [(i, normalized(t)) for i, t in enumerate(pages, 1)]
    return [(i, t) for i, t in texts if t], [f"Page {i} has no text" for i, t in texts if not t] if ext == ".pdf" else []


def parse_documents(files: DataFrame, max_pages: int = 200) -> DataFrame:
    """files (document_hash, source_doc, content) to a row for each page: document_hash, source_doc, page_number, text,
    warnings, error_code (parse_error or no_text, then without a page)."""
    names = ["document_hash", "source_doc", "page_number", "text", "warnings", "error_code"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            # Of the contents only one is a Python object at a time; pages are passed on before they come to much.
            for key, name, raw, ext in zip(*(b.column(c) for c in ("document_hash", "source_doc", "content", "ext")), strict=True):
                key, name, raw = key.as_py(), name.as_py(), raw.as_py()
                try:
                    pages, warnings = parse_file(raw or b"", ext.as_py(), max_pages)
                    rows += [(key, name, i, t, warnings, None) for i, t in pages] or [(key, name, None, None, warnings, "no_text")]
                    held += sum(len(t) for _, t in pages)
                except ValueError as e:
                    rows.append((key, name, None, None, [str(e)], "parse_error"))
                if held > BATCH_BYTES:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return small_batches(files).select("document_hash", "source_doc", "content", extension(F.col("source_doc")).alias("ext")).mapInArrow(run, "document_hash string, source_doc string, page_number int, text string, warnings array<string>, error_code string")


def read_uploads(spark, path: str, max_bytes: int, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files under a path: those to parse (new, valid, each content once), and those refused with error_code.

    Of files alike in content the first by path is taken; `known` has the hashes that are indexed."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    named = raw.select(sanitize_filename(F.col("path")).alias("source_doc"), "path", "content", document_hash(F.col("content")).alias("document_hash"), upload_error(F.col("path"), F.col("content"), max_bytes).alias("error_code"))
    good = named.filter("error_code is null")
    first = good.groupBy("document_hash").agg(F.min("path").alias("path"))
    once = good.join(first, ["document_hash", "path"])
    if known is not None:
        once = once.join(known.select("document_hash").distinct(), "document_hash", "left_anti")
    return once.select("document_hash", "source_doc", "content"), named.filter("error_code is not null").select("source_doc", "document_hash", "error_code")
