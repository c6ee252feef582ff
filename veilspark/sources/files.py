"""Documents in and out: plain text through Spark's readers, binary formats through parsers on the executors."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Callable, Iterable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .file_sink import write_files

# Fixed values.
EXTENSIONS = (".txt", ".md", ".pdf", ".docx", ".xlsx", ".csv")
TEXT = (".txt", ".md")
TABLES = (".csv", ".xlsx")
SKIP = "_pseudonymized"
SNIFFED = 8192
FEW_CHARS_A_PAGE = 50


def discovered(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path of every document under a folder, without what was written by us; sorted by path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return chosen(reader.load(path).select("path")).orderBy("path")


def chosen(paths: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"[^/]+$", 0)
    return paths.where(T.extension("path").isin(*EXTENSIONS) & ~name.contains(SKIP))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of text files, line ends as \\n."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("text", unix_lines("text"))


def unix_lines(text: str):
    return F.regexp_replace(text, "\r\n?", "\n")


def with_doc_id(files: DataFrame) -> DataFrame:
    """A stable number a path."""
    return files.withColumn("doc_id", F.xxhash64("path"))


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, text and error of all documents under a folder; a file that can't be read has an error instead of a text."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    rows = chosen(rows.select("path", "content"))

    def parsed(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            out = [_parsed(p, c) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "text": [t for t, _ in out], "error": [e for _, e in out]})

    return rows.mapInPandas(parsed, "path string, text string, error string")


UNITS = "path string, error string, unit_ord long, sheet_no int, sheet_name string, row int, col int, text string"
#: A unit's number has the sheet's, the row's and the column's in it, in the order in which a document is read.
SHEET_BITS, COLUMN_BITS = 36, 15


def read_units(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """What is detected and rewritten by itself: a text, or a cell of a CSV or XLSX file, with its place and number.

    A sheet without cells has a row without a text, and a file that can't be read one with an error.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    rows = chosen(rows.select("path", "content"))
    columns = [c.split()[0] for c in UNITS.split(", ")]

    def units(path: str, content: bytes) -> Iterable[tuple]:
        if not path.lower().endswith(TABLES):
            text, error = _parsed(path, content)
            yield path, error, 0, None, None, None, None, text
            return
        try:
            sheets = sheets_of(path, content)
        except Exception as error:  # a bad file must not stop the others
            yield path, f"{type(error).__name__}: {error}", 0, None, None, None, None, None
            return
        for k, (name, cells) in enumerate(sheets):
            if not cells:
                yield path, None, k << SHEET_BITS, k, name, None, None, None
            for (r, c), value in sorted(cells.items()):
                yield path, None, (k << SHEET_BITS) + (r << COLUMN_BITS) + c, k, name, r, c, value

    def parsed(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                found = iter(units(p, content))
                while part := list(itertools.islice(found, 10_000)):
                    yield pd.DataFrame(part, columns=columns).astype({"sheet_no": "Int32", "row": "Int32", "col": "Int32"})

    return with_doc_id(rows.mapInPandas(parsed, UNITS))


def sheets_of(path: str, content: bytes) -> list[tuple[str, dict[tuple[int, int], str]]]:
    """(sheet, {(row, column): value}) of a CSV or XLSX file, without blank cells."""
    if path.lower().endswith(".csv"):
        return [("", {(r, c): v for r, line in enumerate(csv_rows(content), 1) for c, v in enumerate(line, 1) if v.strip()})]
    return xlsx_sheets(content)


def _parsed(path: str, content: bytes) -> tuple[str | None, str | None]:
    ext = "." + path.rsplit(".", 1)[-1].lower()
    try:
        return PARSERS.get(ext, text_of_plain)(content), None
    except Exception as error:  # a bad file must not stop the others
        return None, f"{type(error).__name__}: {error}"


def text_of_plain(content: bytes) -> str:
    return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def csv_rows(content: bytes) -> list[list[str]]:
    text = _decoded(content)
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:SNIFFED])
    except csv.Error:
        dialect = csv.excel
    return list(csv.reader(io.StringIO(text, newline=""), dialect))


def text_of_csv(content: bytes) -> str:
    return "\n".join("\t".join(row) for row in csv_rows(content) if any(c.strip() for c in row))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _paragraph(node: ElementTree.Element) -> str:
    marks = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t", f"{_W}br": lambda n: "\n"}
    return "".join(marks[n.tag](n) for n in node.iter() if n.tag in marks)


def _blocks(root: ElementTree.Element) -> list[str]:
    """Paragraphs, then table rows with cells joined by tabs."""
    body = root.find(f"{_W}body") if root.tag == f"{_W}document" else root
    out = [_paragraph(p) for p in body.findall(f"{_W}p")]
    for row in body.iterfind(f"{_W}tbl/{_W}tr"):
        out.append("\t".join("\n".join(_paragraph(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")))
    return [b for b in out if b.strip()]


def text_of_docx(content: bytes) -> str:
    """Headers, paragraphs, table rows and footers, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = sorted(archive.namelist())
        part = lambda kind: [n for n in names if n.startswith(f"word/{kind}") and n.endswith(".xml")]
        out = []
        for name in [*part("header"), "word/document.xml", *part("footer")]:
            out += _blocks(ElementTree.fromstring(archive.read(name)))
    return "\n".join(out)


def xlsx_sheets(content: bytes) -> list[tuple[str, dict[tuple[int, int], str]]]:
    """(sheet, {(row, column): value}) of a workbook; formulas give their stored values."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in archive.namelist():
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{_S}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_S}t")))
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in book.iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            root = ElementTree.fromstring(archive.read(target if target.startswith("xl/") else f"xl/{target}"))
            cells = {}
            for cell in root.iter(f"{_S}c"):
                value = cell.find(f"{_S}v")
                inline = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                text = inline if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text or ""
                if text.strip():
                    cells[_place(cell.get("r"))] = text
            out.append((sheet.get("name"), cells))
        return out


def _place(ref: str) -> tuple[int, int]:
    letters = "".join(c for c in ref if c.isalpha())
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(ref[len(letters) :]), column


def letters(column: int) -> str:
    out = ""
    while column > 0:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def text_of_xlsx(content: bytes) -> str:
    """Cells joined by tabs, rows by line ends, sheets by a blank line."""
    sheets = []
    for _, cells in xlsx_sheets(content):
        rows: dict[int, list[str]] = {}
        for (row, _), value in sorted(cells.items()):
            rows.setdefault(row, []).append(value)
        sheets.append("\n".join("\t".join(r) for _, r in sorted(rows.items())))
    return "\n\n".join(s for s in sheets if s)


def text_of_pdf(content: bytes) -> str:
    """Pages joined by a blank line, through an extractor if one is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        pages = [page.extract_text() or "" for page in pdf.pages]
    if pages and sum(map(len, pages)) < FEW_CHARS_A_PAGE * len(pages):
        raise ValueError("the file seems to be scanned: it has hardly any text")
    return "\n\n".join(pages)


PARSERS: dict[str, Callable[[bytes], str]] = {".csv": text_of_csv, ".docx": text_of_docx, ".xlsx": text_of_xlsx, ".pdf": text_of_pdf}


def write_text(docs: DataFrame, folder: str) -> None:
    """One file a document (name, text) below folder, in UTF-8; a name may be a path."""
    write_files(docs.select("name", F.encode("text", "UTF-8").alias("content")), folder)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """document_name, entity_text, entity_type, start_pos and end_pos of JSON annotations, a file a document."""
    schema = "document_name string, entities array<struct<entity_text string, entity_type string, start_pos int, end_pos int>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("document_name", F.inline("entities"))
