"""Sinks for results: JSON, one file or folder per sheet, and a plain .xlsx workbook."""

from __future__ import annotations

import datetime
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a worksheet in the format itself.
XLSX_ROWS = 1_048_576


def export_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def export_sheets(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """Each sheet as a distributed dataset under the path."""
    out = []
    for name, df in sheets.items():
        target = f"{path}/{name.lower().replace(' ', '_')}"
        df.write.mode("overwrite").format(fmt).option("header", "true").save(target)
        out.append(target)
    return out


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name = chr(65 + i % 26) + name
        i = i // 26 - 1
    return name


def _cell(ref: str, value) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>' if value == value else ""
    text = value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)
    clean = "".join(c for c in text[:32767] if c in "\t\n\r" or ord(c) >= 32)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def write_xlsx(sheets: dict[str, DataFrame], path: str, max_rows: int = 100_000) -> str:
    """A workbook with one frozen, headed worksheet per frame, written by the driver row by row.

    A workbook is for people: a sheet of more than ``max_rows`` rows is refused, not cut; use
    ``export_sheets`` for those.
    """
    if max_rows >= XLSX_ROWS:
        raise ValueError("a worksheet holds no more rows")
    names = list(sheets)
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
    rels = "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1))
    tabs = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for k, name in enumerate(names, 1):
            df = sheets[name]
            if df.limit(max_rows + 1).count() > max_rows:
                raise ValueError(f"sheet {name} has more than {max_rows} rows")
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'{head}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                for r, row in enumerate([df.columns], 1):
                    f.write(f'<row r="{r}">{"".join(_cell(f"{_column(c)}{r}", v) for c, v in enumerate(row))}</row>'.encode())
                for r, row in enumerate(df.toLocalIterator(), 2):
                    f.write(f'<row r="{r}">{"".join(_cell(f"{_column(c)}{r}", v) for c, v in enumerate(row))}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return str(Path(path))
