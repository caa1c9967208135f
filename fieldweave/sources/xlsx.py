"""Workbooks as a Spark data source, reading and writing, over zip and XML alone.

A workbook is one zip file, so it is read by one task; the rows come in sheet order. The
writer collects each partition's rows as a message of its commit and the commit writes the
workbook: meant for reports and dictionaries, refused above ``MOST_ROWS``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MOST_ROWS = 1_000_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheet_file(book: zipfile.ZipFile, name: str | None) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
    chosen = next((s for s in sheets if name in (None, s.get("name"))), None)
    if chosen is None:
        raise ValueError(f"no sheet {name!r}")
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in relations if r.get("Id") == chosen.get(f"{_REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The cells of a sheet as text, row by row."""
    book = zipfile.ZipFile(io.BytesIO(data))
    strings: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
            strings.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
    for row in ElementTree.fromstring(book.read(_sheet_file(book, sheet))).iter(f"{_MAIN}row"):
        cells: list[str | None] = []
        for k, cell in enumerate(row.iter(f"{_MAIN}c")):
            at = _column_number(cell.get("r")) if cell.get("r") else k
            value = cell.find(f"{_MAIN}v")
            if cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            else:
                text = value.text if value is not None else None
                if text is not None and cell.get("t") == "s":
                    text = strings[int(text)]
            cells += [None] * (at + 1 - len(cells))
            cells[at] = text
        yield cells


def workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """A workbook of the given sheets; empty ones are left out, and with none left there is
    one empty sheet, as a workbook must have one."""
    kept = {k: v for k, v in sheets.items() if v} or {"Sheet1": []}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(kept)))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(kept))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(kept)))
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(kept.values()):
            body = "".join("<row>" + "".join(_cell(v) for v in row) + "</row>" for row in rows)
            book.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


class XlsxReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.sheet = schema, options["path"], options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path.removeprefix("file:"), "rb") as f:
            rows = sheet_rows(f.read(), self.sheet)
        head = next(rows, [])
        where = {h: i for i, h in enumerate(head) if h is not None}
        for n, row in enumerate(rows):
            if any(v is not None for v in row):
                yield tuple(n if c == "row_ord" else row[where[c]] if where.get(c, len(row)) < len(row) else None for c in self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    rows: list[list[object]]


class XlsxWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.sheet = schema, options["path"], options.get("sheet", "Sheet1")

    def write(self, iterator: Iterator) -> Written:
        rows = [list(r) for r in iterator]
        if len(rows) > MOST_ROWS:
            raise ValueError(f"a workbook takes {MOST_ROWS} rows; write parquet instead")
        return Written(rows)

    def commit(self, messages: list[Written | None]) -> None:
        rows = [r for m in messages if m for r in m.rows]
        if len(rows) > MOST_ROWS:
            raise ValueError(f"a workbook takes {MOST_ROWS} rows; write parquet instead")
        with open(self.path.removeprefix("file:"), "wb") as f:
            f.write(workbook({self.sheet: [self.schema.names, *rows] if rows else []}))


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        raise ValueError("give a schema; workbooks are not inferred")

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(schema, self.options)
