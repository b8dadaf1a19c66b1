"""Workbooks (.xlsx), read and written with the standard library.

A workbook is a zip of XML parts and is put together on the driver: it holds a million rows a
sheet at most, and write_excel takes that as its bound.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from loomframe.frame import Frame, frame
from loomframe.functions.values import FrameError
from loomframe.sources.files import unique_names
from loomframe.sources.paths import read_bytes, write_bytes

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MOST_ROWS = 1_048_575
# Built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _book(spark: SparkSession, path: str) -> zipfile.ZipFile:
    if path.lower().endswith(".xls"):
        raise FrameError("only .xlsx workbooks are read")
    return zipfile.ZipFile(io.BytesIO(read_bytes(spark, path)))


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names and their parts."""
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ET.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    part = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {s.get("name"): part(targets[s.get(f"{RELS}id")]) for s in sheets}


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    return list(_sheets(_book(spark, path)))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{MAIN}numFmt") if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", f.get("formatCode", "")))}
    xfs = root.find(f"{MAIN}cellXfs")
    return {i for i, x in enumerate(xfs if xfs is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _cells(book: zipfile.ZipFile, part: str) -> list[dict[int, str]]:
    """Texts of the cells that are not empty, by row and column; formulas by their kept result."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml"))]
    dates = _date_styles(book)
    rows = []
    for row in ET.fromstring(book.read(part)).iter(f"{MAIN}row"):
        cells: dict[int, str] = {}
        for at, c in enumerate(row.findall(f"{MAIN}c")):
            value, kind = c.find(f"{MAIN}v"), c.get("t", "n")
            text = value.text if value is not None else None
            if kind == "s" and text is not None:
                text = shared[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            elif kind == "b" and text is not None:
                text = "true" if text == "1" else "false"
            elif kind == "e":
                text = None
            elif text is not None and kind == "n":
                text = _date_text(float(text)) if int(c.get("s", 0)) in dates else _number_text(text)
            if text not in (None, ""):
                cells[_column(c.get("r")) if c.get("r") else at] = text
        rows.append(cells)
    return rows


def _number_text(text: str) -> str:
    return text[:-2] if text.endswith(".0") else text


def _date_text(days: float) -> str:
    """Days since 1899-12-30 as an ISO date, or date and time."""
    at = dt.datetime(1899, 12, 30) + dt.timedelta(seconds=round(days * 86_400))
    return at.date().isoformat() if at.time() == dt.time() else at.isoformat(sep=" ")


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, at: int = 0, header: bool = True) -> Frame:
    """The first row that is not empty names the columns; empty rows are passed over."""
    book = _book(spark, path)
    sheets = _sheets(book)
    if sheet is not None and sheet not in sheets:
        raise FrameError(f"no sheet {sheet!r}; there are {list(sheets)}")
    rows = [r for r in _cells(book, sheets[sheet] if sheet else list(sheets.values())[at]) if r]
    width = max((max(r) + 1 for r in rows), default=0)
    if not width:
        return Frame(spark.createDataFrame([], T.StructType()))
    head = rows.pop(0) if header else {}
    names = unique_names([head.get(i, "") for i in range(width)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return frame([tuple(r.get(i) for i in range(width)) for r in rows], schema=schema, spark=spark).infer_objects(*names)


def sanitized(text: str) -> str:
    return "'" + text if text.lstrip()[:1] in ("=", "+", "-", "@") else text


def _cell_xml(ref: str, value, style: int = 0) -> str:
    mark = f' s="{style}"' if style else ""
    if value is None or isinstance(value, float) and value != value:
        return f'<c r="{ref}"{mark}/>' if style else ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"{mark}><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) < 10**15:
        return f'<c r="{ref}"{mark}><v>{value!r}</v></c>'
    text = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)
    text = sanitized(text) if isinstance(value, str) else text
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return f'<c r="{ref}" t="inlineStr"{mark}><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def sheet_name(name: str, taken: set[str]) -> str:
    name = re.sub(r"[\[\]:*?/\\]", "_", name)[:31] or "Sheet"
    out, k = name, 2
    while out.lower() in taken:
        out, k = f"{name[: 31 - len(str(k)) - 1]}_{k}", k + 1
    taken.add(out.lower())
    return out


def _rows_of(f: Frame) -> tuple[list[str], list[tuple]]:
    names = [c for c in f.df.columns if c not in ("__pos__", "__first__")]
    rows = list(f._with(f.df.limit(MOST_ROWS + 1)).iter_rows())
    if len(rows) > MOST_ROWS:
        raise FrameError(f"a sheet holds {MOST_ROWS} rows")
    at = [f.df.columns.index(n) for n in names]
    return names, [tuple(r[i] for i in at) for r in rows]


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]], styles: dict[str, dict[tuple[int, int], str]] | None = None) -> bytes:
    """styles: sheet -> (row, column) of the body -> background RRGGBB."""
    taken: set[str] = set()
    named = {sheet_name(n, taken): (n, v) for n, v in sheets.items()}
    fills = sorted({c for s in (styles or {}).values() for c in s.values()})
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    pkg = "http://schemas.openxmlformats.org/package/2006"
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        put = lambda name, text: book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(named) + 1))
        put("[Content_Types].xml", f'<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(named, 1)) + "</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Type="{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(named) + 1))
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pkg}/relationships">{rels}<Relationship Id="rId{len(named) + 1}" Type="{doc}/styles" Target="styles.xml"/></Relationships>')
        solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in fills)
        xfs = "".join(f'<xf numFmtId="0" fontId="0" fillId="{i + 2}" borderId="0" xfId="0" applyFill="1"/>' for i in range(len(fills)))
        put("xl/styles.xml", f'<styleSheet {ns}><fonts count="1"><font/></fonts><fills count="{len(fills) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(fills) + 1}"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>{xfs}</cellXfs></styleSheet>')
        for i, (own, (names, rows)) in enumerate(named.values(), 1):
            painted = (styles or {}).get(own, {})
            body = [
                f'<row r="{r}">' + "".join(_cell_xml(f"{_letters(c)}{r}", v, fills.index(painted[r - 2, c]) + 1 if (r - 2, c) in painted else 0) for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate([tuple(names), *rows], 1)
            ]
            put(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{''.join(body)}</sheetData></worksheet>")
    return out.getvalue()


def write_excel(f: Frame, path: str, sheet: str = "Sheet1") -> None:
    write_bytes(f.spark, path, workbook({sheet: _rows_of(f)}))


class ExcelWriter:
    """Several sheets of one workbook: write() each, then close()."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.sheets = spark, path, {}

    def write(self, f: Frame, sheet: str) -> ExcelWriter:
        self.sheets[sheet] = _rows_of(f)
        return self

    def close(self) -> None:
        write_bytes(self.spark, self.path, workbook(self.sheets))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
