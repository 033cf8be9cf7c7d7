"""Workbooks as a Spark data source: a reader and a writer over zip and XML, registered as `xlsx_rows`.

Reading gives row, and for each asked column its text and type; a workbook is one partition, many workbooks (a folder)
are as many. Writing makes one workbook with the deliverable's headers; what was there before is kept as a timestamped
copy. Strings are shared strings or inline; numbers are numbers; a null is no cell.
"""

from __future__ import annotations

import os
import re
import shutil
import time
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Headers and widths of the deliverable.
HEADERS = ("SERVEY#", "METER#", "REMARKS")
WIDTHS = (12, 16, 40)
SHEET = "Sheet1"


def column_index(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_path(z: zipfile.ZipFile, sheet: str | None) -> str:
    """Where the named sheet lies, else the active one, else the first."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = {s.get("name"): targets[s.get(REL)] for s in book.find("m:sheets", NS)}
    view = book.find("m:bookViews/m:workbookView", NS)
    active = int(view.get("activeTab") or 0) if view is not None else 0
    paths = list(sheets.values())
    target = sheets.get(sheet) or paths[active if active < len(paths) else 0]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def read_sheet(path: str, sheet: str | None = None, columns: int = 3, first_row: int = 2, only: int | None = None):
    """(row, [(text, kind)]) of the named sheet, else the active one; rows that are all empty are passed over.

    only: the one column whose cells are looked at; the others are not decoded.
    """
    with zipfile.ZipFile(path) as z:
        name = _sheet_path(z, sheet)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in root]
        for _, row in ElementTree.iterparse(z.open(name)):
            if row.tag != f"{{{NS['m']}}}row":
                continue
            number, cells = int(row.get("r")), [(None, "")] * columns
            for c in row:
                at = column_index(c.get("r"))
                if at >= columns or only is not None and at != only:
                    continue
                value, kind = c.find("m:v", NS), c.get("t", "n")
                if kind == "inlineStr":
                    cells[at] = ("".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t")), "text")
                elif value is not None:
                    cells[at] = (shared[int(value.text)], "text") if kind == "s" else (value.text, "text" if kind == "str" else "number")
            row.clear()
            if number >= first_row and any(v is not None for v, _ in cells):
                yield number, cells


@dataclass
class Sheet:
    """name, rows (lists of None, str, int or float), column widths, the fill of a row by its number (0-based), rows that stay in view."""

    name: str
    rows: list
    widths: tuple | list
    fills: dict[int, str] = field(default_factory=dict)
    frozen: int = 0


# Fills of rows to look at and of rows that a rule changed.
FILL_REVIEW, FILL_CORRECTED = "FFC7CE", "FFEB9C"
FILLS = (FILL_REVIEW, FILL_CORRECTED)


def letters(i: int) -> str:
    """The name of a column: 0 is A, 26 is AA."""
    return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def sheet_xml(sheet: Sheet) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', f'<worksheet xmlns="{NS["m"]}">']
    if sheet.frozen:
        out.append(f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{sheet.frozen}" topLeftCell="A{sheet.frozen + 1}" state="frozen"/></sheetView></sheetViews>')
    out.append("<cols>")
    out += [f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(sheet.widths, 1)]
    out.append("</cols><sheetData>")
    for r, row in enumerate(sheet.rows, 1):
        style = f' s="{FILLS.index(sheet.fills[r - 1]) + 1}"' if r - 1 in sheet.fills else ""
        cells = []
        for c, value in enumerate(row):
            ref = f"{letters(c)}{r}"
            if isinstance(value, int | float):
                cells.append(f'<c r="{ref}"{style}><v>{value}</v></c>')
            elif value is not None:
                cells.append(f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    out.append("</sheetData></worksheet>")
    return "".join(out)


def _styles() -> str:
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS)
    fonts = "<fonts><font/></fonts>"
    fills = f'<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills>'
    formats = "".join(f'<xf fillId="{i + 2}" applyFill="1"/>' for i in range(len(FILLS)))
    return f'<styleSheet xmlns="{NS["m"]}">{fonts}{fills}<borders><border/></borders><cellXfs><xf/>{formats}</cellXfs></styleSheet>'


def write_sheets(path: str, sheets: list[Sheet]) -> str | None:
    """Writes a workbook; returns the copy kept of an earlier file."""
    backup = None
    if os.path.exists(path):
        stem, ext = os.path.splitext(path)
        backup = f"{stem}_{time.strftime('%Y%m%d_%H%M%S')}{ext}"
        shutil.copy2(path, backup)
    kind = "http://schemas.openxmlformats.org"
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbered = list(enumerate(sheets, 1))
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{main}.worksheet+xml"/>' for i, _ in numbered)
    named = "".join(f'<sheet name="{escape(s.name)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in numbered)
    linked = "".join(f'<Relationship Id="rId{i}" Type="{kind}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered)
    linked += f'<Relationship Id="rId{len(sheets) + 1}" Type="{kind}/officeDocument/2006/relationships/styles" Target="styles.xml"/>'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{kind}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{main}.styles+xml"/>{parts}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{kind}/package/2006/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{NS["m"]}" xmlns:r="{kind}/officeDocument/2006/relationships"><sheets>{named}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kind}/package/2006/relationships">{linked}</Relationships>',
        "xl/styles.xml": _styles(),
    } | {f"xl/worksheets/sheet{i}.xml": sheet_xml(s) for i, s in numbered}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return backup


def write_book(path: str, rows) -> str | None:
    """The deliverable: one sheet under its headers."""
    return write_sheets(path, [Sheet(SHEET, [HEADERS, *rows], WIDTHS)])


class XlsxRows(DataSource):
    """Options: path (a file or a folder), sheet, only. Columns: file, row, survey, meter, remarks, remarks_type.

    only names the one column to read (survey, meter or remarks); the others are null, and rows without it are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return "file string, row int, survey string, meter string, remarks string, remarks_type string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(dict(self.options), [f.name for f in schema])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        path = self.options["path"]
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".xlsx")) if os.path.isdir(path) else [path]
        return [InputPartition(f) for f in files]

    def read(self, partition):
        only = self.options.get("only")
        at = ("survey", "meter", "remarks").index(only) if only else None
        for number, cells in read_sheet(partition.value, self.options.get("sheet"), only=at):
            if at is not None:
                value, kind = cells[at]
                cells[at] = (value.strip(), kind)
                if not value.strip():
                    continue
            (survey, _), (meter, _), (remarks, kind) = cells
            yield os.path.basename(partition.value), number, survey, meter, remarks, kind if remarks is not None else ""


class _Message(WriterCommitMessage):
    def __init__(self, rows: list):
        self.rows = rows


class _Writer(DataSourceWriter):
    """One workbook from all tasks' rows: survey, meter, remarks_text, remarks_num and ord, which sorts them."""

    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def write(self, iterator):
        at = {n: i for i, n in enumerate(self.names)}
        rows = []
        for r in iterator:
            number = r[at["remarks_num"]]
            rows.append((r[at["ord"]], [r[at["survey"]], r[at["meter"]], int(number) if number is not None else r[at["remarks_text"]]]))
        return _Message(rows)

    def commit(self, messages):
        rows = sorted((x for m in messages if m for x in m.rows), key=lambda x: x[0])
        write_book(self.options["path"], [r for _, r in rows])

    def abort(self, messages):
        return None


def register(spark) -> None:
    spark.dataSource.register(XlsxRows)
