"""Tables as cells: one row a non-blank cell, addressed by sheet, row and column."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import files

SCHEMA = "path string, sheet_name string, row int, col int, value string"


def cells_of(rows: DataFrame, keys: list[str], columns: list[str], row: str) -> DataFrame:
    """Cells of a wide table: keys, row, col (from 1), column_letter, value and cell_ref; blank ones are left out."""
    values = F.array(*[F.col(c).cast("string") for c in columns])
    out = rows.select(*keys, F.col(row).cast("int").alias("row"), F.posexplode(values).alias("_p", "value"))
    out = out.where(F.trim("value") != "").withColumn("col", F.col("_p") + 1).drop("_p")
    return with_refs(out)


def with_refs(cells: DataFrame) -> DataFrame:
    out = cells.withColumn("column_letter", T.column_letter("col"))
    ref = F.concat("column_letter", F.col("row").cast("string"))
    if "sheet_name" in cells.columns:
        ref = F.when(F.coalesce("sheet_name", F.lit("")) == "", ref).otherwise(F.concat_ws("!", "sheet_name", ref))
    return out.withColumn("cell_ref", ref)


def read_cells(spark, path: str, recursive: bool = False) -> DataFrame:
    """Cells of the CSV and XLSX files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    rows = files.chosen(rows.select("path", "content")).where(T.extension("path").isin(".csv", ".xlsx"))

    def parsed(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                for name, cells in files.sheets_of(p, content):
                    found = [(p, name, r, c, v) for (r, c), v in sorted(cells.items())]
                    yield pd.DataFrame(found, columns=["path", "sheet_name", "row", "col", "value"])

    return with_refs(rows.mapInPandas(parsed, SCHEMA))


def grid(cells: DataFrame, keys: list[str], n_columns: int) -> DataFrame:
    """Dense rows: keys, row and c1..cn, empty strings where there is no cell."""
    wide = cells.groupBy(*keys, "row").pivot("col", list(range(1, n_columns + 1))).agg(F.first("value"))
    return wide.select(*keys, "row", *[F.coalesce(F.col(str(i)), F.lit("")).alias(f"c{i}") for i in range(1, n_columns + 1)])


def row_texts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row and its text: cells of all columns up to the table's last one, joined by tabs."""
    wide = cells.withColumn("_n", F.max("col").over(Window.partitionBy(*keys)))
    rows = wide.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"), F.first("_n").alias("_n"))
    joined = F.array_join(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(""))), "\t")
    return rows.select(*keys, "row", joined.alias("text"))


def sheet_texts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the table's text, a line a row."""
    rows = row_texts(cells, keys)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda r: r["text"]), "\n").alias("text"))


def write_csv(cells: DataFrame, folder: str, n_columns: int) -> None:
    """A dense CSV a sheet, under folder."""
    keys = [k for k in ("path", "sheet_name") if k in cells.columns]
    rows = grid(cells, keys, n_columns).repartition(*keys) if keys else grid(cells, keys, n_columns)
    rows.sortWithinPartitions(*keys, "row").select(*[f"c{i}" for i in range(1, n_columns + 1)]).write.mode("overwrite").csv(folder)


def xlsx_bytes(sheets: list[tuple[str, dict[tuple[int, int], str]]]) -> bytes:
    """A workbook with the sheets' values as inline strings."""
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        archive.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        archive.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name={quoteattr(name or "Sheet1")} sheetId="{k}" r:id="rId{k}"/>' for k, (name, _) in enumerate(sheets, 1))
        archive.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        archive.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">{links}</Relationships>')
        for k, (_, cells) in enumerate(sheets, 1):
            rows: dict[int, list[str]] = {}
            for (r, c), value in sorted(cells.items()):
                rows.setdefault(r, []).append(f'<c r="{files.letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
            data = "".join(f'<row r="{r}">{"".join(x)}</row>' for r, x in sorted(rows.items()))
            archive.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {main}><sheetData>{data}</sheetData></worksheet>")
    return out.getvalue()


def workbooks(cells: DataFrame) -> DataFrame:
    """path and content of a workbook a file, from cells(path, sheet_name, row, col, value). A workbook is made in one piece."""

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        sheets = [(name, {(r, c): v for r, c, v in zip(part["row"], part["col"], part["value"], strict=True)}) for name, part in frame.groupby("sheet_name", sort=True)]
        return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [xlsx_bytes(sheets)]})

    return cells.select("path", "sheet_name", "row", "col", "value").groupBy("path").applyInPandas(made, "path string, content binary")


def csv_bytes(sheets: list[tuple[str, dict[tuple[int, int], str]]]) -> bytes:
    """Sheets as one CSV with commas, a dense grid each, with an empty line between them."""
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    for k, (_, cells) in enumerate(sheets):
        if k:
            writer.writerow([])
        rows, columns = (max((place[i] for place in cells), default=0) for i in (0, 1))
        writer.writerows([[cells.get((r, c), "") for c in range(1, columns + 1)] for r in range(1, rows + 1)])
    return out.getvalue().encode()


def table_files(units: DataFrame) -> DataFrame:
    """name and content of a file a name, in the name's format, from units(name, sheet_no, sheet_name, row, col, text).

    All sheets are there in their order, those without cells too. A file is made in one piece, as it was read.
    """

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["name"].iloc[0]
        sheets = []
        for _, part in frame.groupby("sheet_no", sort=True):
            own = part[part["row"].notna()]
            cells = {(int(r), int(c)): v for r, c, v in zip(own["row"], own["col"], own["text"], strict=True)}
            sheets.append((part["sheet_name"].iloc[0] or "", cells))
        content = csv_bytes(sheets) if name.lower().endswith(".csv") else xlsx_bytes(sheets)
        return pd.DataFrame({"name": [name], "content": [content]})

    return units.select("name", "sheet_no", "sheet_name", "row", "col", "text").groupBy("name").applyInPandas(made, "name string, content binary")
