"""xlsx workbooks from table rows, with templates, and workbooks as rows of a DataFrame.

A workbook is one row and is made by one task, as its format demands; many workbooks are many rows.
Columns named __x__ steer: __path__ names the workbook, __sheet__ the sheet, __rowid__ the order; none
of them is shown. In a template, texts <<TABLE_STARTS_HERE>>, <<HEADER_STYLE>>, <<CELL_STYLE>> and
<<COLUMN_STYLE:name>> give the place of the table and the styles of its cells. A text too long for a cell is an error.
"""

from __future__ import annotations

import datetime
import decimal
import io
import itertools
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import IO, Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbrook.errors import PlumbrookError

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
ET.register_namespace("", MAIN)
ET.register_namespace("r", REL)

PATH, SHEET, ROW_ID = "__path__", "__sheet__", "__rowid__"
SPECIAL_COLUMN = re.compile(r"__.*__")
_MARK = re.compile(r"<<(TABLE_STARTS_HERE|HEADER_STYLE|CELL_STYLE|COLUMN_STYLE)(?::(.*))?>>")
_ANY_MARK = re.compile(r"<<.*>>")
#: UTF-16 units that a cell holds; longer texts raise.
MOST_TEXT = 32_767
#: Rows that a sheet holds; more raise.
MOST_ROWS = 1_048_576
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


@dataclass(frozen=True)
class AutoSize:
    """Widths: the longest text of a column, its name counting up to name_cap, between least and most."""

    name_cap: int = 12
    least: int = 4
    most: int = 64
    scale: float = 1.4


@dataclass(frozen=True)
class WorkbookConfig:
    use_header: bool = True
    auto_size_columns: bool = True
    auto_size: AutoSize = field(default_factory=AutoSize)
    convert_cents_to_currency: bool = True
    convert_unsupported_types_to_string: bool = False
    currency_format: str = "$#,##0_);($#,##0)"
    date_format: str = "M/D/YYYY"
    timestamp_format: str = "dd-mm-yyyy hh:mm:ss"
    template_xlsx: bytes | None = None
    #: Rows of a new sheet that are held as elements; the ones before are written to a file meanwhile. None holds all.
    row_window: int | None = None


@dataclass
class Sheet:
    name: str
    columns: list[str]
    rows: list[Sequence[Any]]


_EMPTY = {
    "[Content_Types].xml": f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets/></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{REL}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font><sz val="11"/><name val="Calibri"/></font></fonts><fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/></cellXfs></styleSheet>',
}


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def column_letters(number: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell_place(address: str) -> tuple[int, int]:
    """(row, column), from 0, of an address such as B4."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", address)
    return int(m[2]) - 1, reduce(lambda n, c: n * 26 + ord(c) - 64, m[1], 0) - 1


def serial(value: datetime.date) -> float:
    """Days since the format's day zero."""
    moment = value if isinstance(value, datetime.datetime) else datetime.datetime(value.year, value.month, value.day)
    return (moment.replace(tzinfo=None) - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)


class _Package:
    """The parts of a workbook file."""

    def __init__(self, template: bytes | None):
        self.parts: dict[str, bytes] = {k: v.encode() for k, v in _EMPTY.items()}
        if template:
            with zipfile.ZipFile(io.BytesIO(template)) as z:
                self.parts = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
        self.workbook = ET.fromstring(self.parts["xl/workbook.xml"])
        self.rels = ET.fromstring(self.parts["xl/_rels/workbook.xml.rels"])
        self.types = ET.fromstring(self.parts["[Content_Types].xml"])
        self.styles = ET.fromstring(self.parts["xl/styles.xml"])
        self.strings = self._strings()
        self.sheets: dict[str, tuple[str, ET.Element]] = {}
        targets = {r.get("Id"): r.get("Target") for r in self.rels}
        for s in self.workbook.find(_tag("sheets")):
            target = targets[s.get(f"{{{REL}}}id")]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            self.sheets[s.get("name")] = (part, ET.fromstring(self.parts[part]))
        self._styled: dict[tuple[int, str], int] = {}
        #: Rows of sheets that left their window, by part.
        self.flushed: dict[str, IO[bytes]] = {}

    def flush(self, name: str, rows: list[ET.Element]) -> None:
        """Write rows of a sheet behind those that were written before."""
        out = self.flushed.setdefault(self.sheets[name][0], tempfile.SpooledTemporaryFile(max_size=1 << 20))
        for row in rows:
            out.write(ET.tostring(row).replace(f' xmlns="{MAIN}"'.encode(), b""))
        rows.clear()

    def _strings(self) -> list[str]:
        data = self.parts.get("xl/sharedStrings.xml")
        return ["".join(t.text or "" for t in si.iter(_tag("t"))) for si in ET.fromstring(data)] if data else []

    def text_of(self, cell: ET.Element) -> str | None:
        if cell.get("t") == "s" and (v := cell.find(_tag("v"))) is not None:
            return self.strings[int(v.text)]
        if cell.get("t") == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(_tag("t")))
        return None

    def sheet(self, name: str) -> ET.Element:
        if name not in self.sheets:
            numbers = [int(s.get("sheetId")) for s in self.workbook.find(_tag("sheets"))]
            used = {r.get("Id") for r in self.rels}
            n = max([0, *numbers]) + 1
            rel = next(f"rId{k}" for k in range(1, 10_000) if f"rId{k}" not in used)
            part = f"xl/worksheets/added{n}.xml"
            ET.SubElement(self.workbook.find(_tag("sheets")), _tag("sheet"), {"name": name, "sheetId": str(n), f"{{{REL}}}id": rel})
            ET.SubElement(self.rels, f"{{{PACKAGE}}}Relationship", {"Id": rel, "Type": f"{REL}/worksheet", "Target": part.removeprefix("xl/")})
            ET.SubElement(self.types, f"{{{TYPES}}}Override", {"PartName": f"/{part}", "ContentType": "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"})
            self.sheets[name] = (part, ET.fromstring(f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>'))
        return self.sheets[name][1]

    def style(self, base: int, number_format: str | None) -> int:
        """The number of the base style with a number format."""
        if number_format is None:
            return base
        if (base, number_format) not in self._styled:
            formats = self.styles.find(_tag("numFmts"))
            if formats is None:
                formats = ET.Element(_tag("numFmts"), {"count": "0"})
                self.styles.insert(0, formats)
            known = {f.get("formatCode"): int(f.get("numFmtId")) for f in formats}
            if number_format not in known:
                known[number_format] = max([163, *known.values()]) + 1
                ET.SubElement(formats, _tag("numFmt"), {"numFmtId": str(known[number_format]), "formatCode": number_format})
                formats.set("count", str(len(formats)))
            xfs = self.styles.find(_tag("cellXfs"))
            xf = ET.fromstring(ET.tostring(xfs[base]))
            xf.set("numFmtId", str(known[number_format]))
            xf.set("applyNumberFormat", "1")
            xfs.append(xf)
            xfs.set("count", str(len(xfs)))
            self._styled[base, number_format] = len(xfs) - 1
        return self._styled[base, number_format]

    def content(self) -> bytes:
        own = {"xl/workbook.xml": self.workbook, "xl/styles.xml": self.styles} | {part: tree for part, tree in self.sheets.values()}
        for name, tree in own.items():
            self.parts[name] = ET.tostring(tree, xml_declaration=True, encoding="UTF-8")
        for name, tree, space in (("xl/_rels/workbook.xml.rels", self.rels, PACKAGE), ("[Content_Types].xml", self.types, TYPES)):
            self.parts[name] = _flat_xml(tree, space)
        self.parts.pop("xl/calcChain.xml", None) if "xl/calcChain.xml" not in {r.get("Target") for r in self.rels} else None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in self.parts.items():
                entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                entry.compress_type = zipfile.ZIP_DEFLATED
                with z.open(entry, "w", force_zip64=name in self.flushed) as part:
                    if (rows := self.flushed.get(name)) is None:
                        part.write(data)
                        continue
                    head, _, tail = data.partition(b"<sheetData />")
                    part.write(head + b"<sheetData>")
                    rows.seek(0)
                    shutil.copyfileobj(rows, part)
                    part.write(b"</sheetData>" + tail)
                    rows.close()
        return out.getvalue()


def _flat_xml(tree: ET.Element, space: str) -> bytes:
    """A root with childless elements, all in one namespace that needs no prefix."""
    local = lambda e: e.tag.rpartition("}")[2]
    children = "".join(f"<{local(e)} {' '.join(f'{k}={quoteattr(v)}' for k, v in e.attrib.items())}/>" for e in tree)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<{local(tree)} xmlns="{space}">{children}</{local(tree)}>'.encode()


@dataclass
class _Marks:
    """What a template's sheet says about the table."""

    start: tuple[int, int] = (0, 0)
    header: int | None = None
    cell: int | None = None
    columns: dict[str, int] = field(default_factory=dict)
    style_rows: set[tuple[int, int]] = field(default_factory=set)


def _read_marks(package: _Package, tree: ET.Element) -> _Marks:
    """The marks of a sheet, which are removed from it."""
    marks = _Marks()
    for row in tree.find(_tag("sheetData")):
        for cell in list(row):
            text = package.text_of(cell)
            if text is None or not _ANY_MARK.fullmatch(text):
                continue
            m = _MARK.fullmatch(text)
            if not m:
                raise PlumbrookError(f"unknown mark {text} in the template")
            place, style = cell_place(cell.get("r")), int(cell.get("s", "0"))
            if m[1] == "TABLE_STARTS_HERE":
                marks.start = place
            elif m[1] == "HEADER_STYLE":
                marks.header = style
            elif m[1] == "CELL_STYLE":
                marks.cell = style
                marks.style_rows.add(place)
            else:
                marks.columns[m[2] or ""] = style
                marks.style_rows.add(place)
            if m[1] == "TABLE_STARTS_HERE" and marks.header is None:
                marks.header = style
            row.remove(cell)
    return marks


def _converters(sheet: Sheet, config: WorkbookConfig) -> tuple[list[int], list[str], list[Callable[[Any], Any]], list[str | None]]:
    """Shown columns with their titles, value conversions and number formats; nulls stay null."""
    kept, titles, convert, formats = [], [], [], []
    for k, name in enumerate(sheet.columns):
        if SPECIAL_COLUMN.fullmatch(name):
            continue
        values = [r[k] for r in sheet.rows if r[k] is not None]
        kept.append(k)
        whole = bool(values) and all(isinstance(v, int) and not isinstance(v, bool) for v in values)
        if config.convert_cents_to_currency and name.endswith("_cents") and whole:
            titles.append(name.removesuffix("_cents"))
            convert.append(lambda v: v / 100.0)
            formats.append(config.currency_format)
        else:
            titles.append(name)
            convert.append(lambda v: v)
            dated = bool(values) and isinstance(values[0], datetime.date)
            formats.append((config.timestamp_format if isinstance(values[0], datetime.datetime) else config.date_format) if dated else None)
    return kept, titles, convert, formats


def _cell(row: ET.Element, place: tuple[int, int], value: Any, style: int, config: WorkbookConfig) -> None:
    cell = ET.SubElement(row, _tag("c"), {"r": f"{column_letters(place[1])}{place[0] + 1}"})
    if style:
        cell.set("s", str(style))
    if value is None:
        return
    if isinstance(value, bool):
        cell.set("t", "b")
        ET.SubElement(cell, _tag("v")).text = "1" if value else "0"
    elif isinstance(value, datetime.date):
        ET.SubElement(cell, _tag("v")).text = repr(serial(value))
    elif isinstance(value, int | decimal.Decimal) or isinstance(value, float) and value - value == 0:
        ET.SubElement(cell, _tag("v")).text = str(value)
    elif isinstance(value, str | float) or config.convert_unsupported_types_to_string:
        cell.set("t", "inlineStr")
        text = ET.SubElement(ET.SubElement(cell, _tag("is")), _tag("t"), {"{http://www.w3.org/XML/1998/namespace}space": "preserve"})
        text.text = _ILLEGAL.sub("", str(value))
        if len(text.text.encode("utf-16-le", "surrogatepass")) > 2 * MOST_TEXT:
            raise PlumbrookError(f"the text of cell {cell.get('r')} is longer than the {MOST_TEXT} characters a cell holds")
    else:
        raise PlumbrookError(f"values of type {type(value).__name__} can't be written to a cell")


def _place_table(package: _Package, sheet: Sheet, config: WorkbookConfig) -> None:
    tree = package.sheet(sheet.name)
    marks = _read_marks(package, tree)
    order = sheet.columns.index(ROW_ID) if ROW_ID in sheet.columns else None
    rows = sorted(sheet.rows, key=lambda r: r[order]) if order is not None else sheet.rows
    kept, titles, convert, formats = _converters(sheet, config)
    data = tree.find(_tag("sheetData"))
    existing = {int(r.get("r")): r for r in data}
    top, left = marks.start
    base = [marks.columns.get(t, marks.columns.get(sheet.columns[k], marks.cell or 0)) for t, k in zip(titles, kept, strict=True)]
    styles = [package.style(b, f) for b, f in zip(base, formats, strict=True)]
    if top + len(rows) + config.use_header > MOST_ROWS:
        raise PlumbrookError(f"sheet {sheet.name} would have more than the {MOST_ROWS} rows a sheet holds")
    shown = ([None if r[k] is None else c(r[k]) for k, c in zip(kept, convert, strict=True)] for r in rows)
    window: list[ET.Element] | None = [] if config.row_window and not existing else None
    longest = [min(len(t), config.auto_size.name_cap) for t in titles]
    for n, values in enumerate(itertools.chain([titles] if config.use_header else [], shown)):
        number = top + n + 1
        row = existing.get(number)
        if window is not None:
            if len(window) >= config.row_window:
                package.flush(sheet.name, window)
            row = ET.Element(_tag("row"), {"r": str(number)})
            window.append(row)
        elif row is None:
            row = existing[number] = ET.SubElement(data, _tag("row"), {"r": str(number)})
        row.attrib.pop("spans", None)
        header = config.use_header and n == 0
        if not header:
            longest = [max(w, len(str(v))) if v is not None else w for w, v in zip(longest, values, strict=True)]
        taken = {cell_place(c.get("r"))[1] for c in row}
        for c, value in enumerate(values):
            if left + c in taken:
                row.remove(next(x for x in row if cell_place(x.get("r"))[1] == left + c))
            _cell(row, (top + n, left + c), value, (marks.header or 0) if header else styles[c], config)
        row[:] = sorted(row, key=lambda x: cell_place(x.get("r"))[1])
    if window:
        package.flush(sheet.name, window)
    data[:] = sorted(data, key=lambda r: int(r.get("r")))
    if (old := tree.find(_tag("dimension"))) is not None:
        tree.remove(old)
    last = top + len(rows) + config.use_header
    for formatting in tree.iter(_tag("conditionalFormatting")):
        formatting.set("sqref", " ".join(_extended(r, marks.style_rows, last) for r in formatting.get("sqref", "").split()))
    if config.auto_size_columns:
        _set_widths(tree, left, longest, config.auto_size)


def _extended(area: str, style_cells: set[tuple[int, int]], last: int) -> str:
    """A range over a style cell, down to the last row."""
    first, _, end = area.partition(":")
    (r0, c0), (r1, c1) = cell_place(first), cell_place(end or first)
    if any(r0 <= r <= r1 and c0 <= c <= c1 for r, c in style_cells):
        return f"{column_letters(c0)}{r0 + 1}:{column_letters(c1)}{max(last, r1 + 1)}"
    return area


def _set_widths(tree: ET.Element, left: int, longest: list[int], size: AutoSize) -> None:
    cols = tree.find(_tag("cols"))
    if cols is None:
        cols = ET.Element(_tag("cols"))
        tree.insert(list(tree).index(tree.find(_tag("sheetData"))), cols)
    for c, length in enumerate(longest):
        width = min(max(length, size.least), size.most) * size.scale
        for old in [x for x in cols if int(x.get("min")) == int(x.get("max")) == left + c + 1]:
            cols.remove(old)
        ET.SubElement(cols, _tag("col"), {"min": str(left + c + 1), "max": str(left + c + 1), "width": f"{width:.4f}", "customWidth": "1"})
    cols[:] = sorted(cols, key=lambda x: int(x.get("min")))


def workbook_bytes(sheets: Sequence[Sheet], config: WorkbookConfig = WorkbookConfig()) -> bytes:
    package = _Package(config.template_xlsx)
    for sheet in sheets:
        _place_table(package, sheet, config)
    if not package.sheets:
        package.sheet("Sheet1")
    return package.content()


def _sheet_of(name: str, rows: Sequence[Any]) -> Sheet:
    columns = list(rows[0].__fields__) if rows else []
    return Sheet(name, columns, [tuple(r) for r in rows])


def to_excel_files(dfs: Sequence[DataFrame], config: WorkbookConfig = WorkbookConfig()) -> DataFrame:
    """path, content: one workbook per __path__ with a sheet of every DataFrame; those without paths are in all.

    Each sheet's rows are gathered in one row, as a sheet (of at most 1,048,576 rows) has to be.
    """
    if not dfs:
        raise PlumbrookError("a workbook without sheets can't be written")
    parts = []
    for k, df in enumerate(dfs):
        keys = [c for c in (PATH, SHEET) if c in df.columns]
        rows = F.collect_list(F.struct(*(F.col(f"`{c}`") for c in df.columns), F.col(ROW_ID) if ROW_ID not in df.columns else F.lit(None).alias("__order__")))
        numbered = df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())
        sheet_name = F.col(SHEET) if SHEET in keys else F.lit(f"Sheet{k + 1}")
        grouped = numbered.groupBy(*keys).agg(rows.alias("rows")).select(*[c for c in keys if c == PATH], F.struct(sheet_name.alias("name"), "rows").alias("sheet"))
        own = grouped.groupBy(PATH) if PATH in keys else grouped.groupBy()
        parts.append((PATH in keys, own.agg(F.collect_list("sheet").alias(f"s{k}"))))
    with_path = [df for has, df in parts if has]
    out = reduce(lambda a, b: a.join(b, PATH, "full"), with_path) if with_path else None
    for df in (df for has, df in parts if not has):
        out = df if out is None else out.crossJoin(df)  # one row: a sheet that all workbooks share
    path = F.coalesce(F.col(PATH), F.lit("workbook.xlsx")) if with_path else F.lit("workbook.xlsx")
    make = F.udf(lambda *lists: workbook_bytes([_sheet_of(s.name, s.rows) for sheets in lists for s in sheets or ()], config), "binary")
    return out.select(path.alias("path"), make(*(F.col(f"s{k}") for k in range(len(dfs)))).alias("content"))


def to_excel(sheets: Any, options: Mapping[str, Any] | None = None) -> bytes | None:
    """The SQL function: a struct of arrays of structs, each a sheet by its name, and option texts."""
    if sheets is None:
        return None
    known = {k: v for k, v in (options or {}).items()}
    config = WorkbookConfig()
    for k, v in known.items():
        if not hasattr(config, k):
            raise PlumbrookError(f"unknown workbook option {k}")
        old = getattr(config, k)
        config = replace(config, **{k: (str(v).lower() == "true") if isinstance(old, bool) else bytes(v) if k == "template_xlsx" else int(v) if k == "row_window" else v})
    return workbook_bytes([_sheet_of(name, rows) for name, rows in zip(sheets.__fields__, sheets, strict=True) if rows is not None], config)


CELL = "path string, sheet string, row_no int, column_no int, value string"


def workbook_cells(content: bytes) -> list[tuple[str, int, int, str]]:
    """Sheet, row and column (from 1) and text of every cell with a value; numbers as they are written."""
    package, out = _Package(content), []
    for name, (_, tree) in package.sheets.items():
        for cell in tree.iter(_tag("c")):
            text = package.text_of(cell)
            if text is None and (value := cell.find(_tag("v"))) is not None:
                text = value.text
            if text is not None:
                row, column = cell_place(cell.get("r"))
                out.append((name, row + 1, column + 1, text))
    return out


def excel_cells(files: DataFrame) -> DataFrame:
    """The cells of workbooks (path, content): CELL."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *cell) for path, content in zip(frame["path"], frame["content"], strict=True) for cell in workbook_cells(content)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row_no", "column_no", "value"])

    return files.select("path", "content").mapInPandas(read, CELL)


def register(spark: SparkSession) -> None:
    """to_excel(named_struct(...), map(...)) in SQL."""
    spark.udf.register("to_excel", to_excel, "binary")


def to_excel_column(sheets: Column, options: Column | None = None) -> Column:
    return F.udf(to_excel, "binary")(sheets, options if options is not None else F.lit(None).cast("map<string,string>"))
