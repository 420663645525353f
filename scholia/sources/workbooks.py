"""Spreadsheet files: workbooks read by any path that Spark opens, and written by tasks, to appear only on commit."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows that are handed to Spark at once, and sheets of a workbook.
ROWS, SHEETS_PER_BOOK = 4096, 16
# Names of the format's parts and spaces.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_CODED = re.compile("_x([0-9A-Fa-f]{4})_")


def coded(text: str) -> str:
    """The text with characters that XML can't hold as _xHHHH_, as the format has it."""
    return escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", text).replace("\r", "_x000D_"))


def decoded(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


def _cell(value: Any) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value - value == 0:
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{coded(str(value))}</t></is></c>'


class Book:
    """A workbook while it is written, sheet by sheet and row by row."""

    def __init__(self, out, header: Sequence[str]):
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        self.header, self.sheets, self.part = header, [], None

    def add(self, sheet: int, values: Sequence[Any]) -> None:
        if not self.sheets or self.sheets[-1] != sheet:
            self._end()
            self.sheets.append(sheet)
            self.part = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w")
            self.part.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            self._row(self.header)
        self._row(values)

    def _row(self, values: Sequence[Any]) -> None:
        self.part.write(f"<row>{''.join(map(_cell, values))}</row>".encode())

    def _end(self) -> None:
        if self.part:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()
            self.part = None

    def close(self) -> None:
        self._end()
        n = range(1, len(self.sheets) + 1)
        named = "".join(f'<sheet name="Sheet{name}" sheetId="{i}" r:id="rId{i}"/>' for i, name in zip(n, self.sheets))
        parts = {
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{named}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>",
        }
        for name, text in parts.items():
            self.zip.writestr(name, HEAD + text)
        self.zip.close()


def place_of(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)


@dataclass
class Books(WriterCommitMessage):
    """Workbooks that a task has finished: pending path and final name."""

    files: list[tuple[str, str]]


class WorkbookWriter(DataSourceWriter):
    """Each task streams its books into a pending folder; commit moves those of the tasks that counted, abort drops all."""

    def __init__(self, schema: StructType, path: str, overwrite: bool):
        self.names, self.path, self.overwrite = schema.names, path.rstrip("/"), overwrite
        self.pending = f"{self.path}/_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Books:
        files, out, book, name = [], None, None, None
        store, folder = place_of(self.pending)
        store.create_dir(folder, recursive=True)
        for row in iterator:
            if row[0] != name:
                if book:
                    book.close()
                    out.close()
                name = row[0]
                files.append((f"{folder}/{uuid.uuid4().hex}.xlsx", f"book-{name:05d}.xlsx"))
                out = store.open_output_stream(files[-1][0])
                book = Book(out, self.names[2:])
            book.add(row[1], row[2:])
        if book:
            book.close()
            out.close()
        return Books(files)

    def commit(self, messages: list[Books | None]) -> None:
        store, folder = place_of(self.path)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.base_name.endswith(".xlsx"):
                    store.delete_file(info.path)
        for message in messages:
            for pending, name in message.files if message else []:
                store.move(pending, f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Books | None]) -> None:
        store, folder = place_of(self.pending)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class Workbooks(DataSource):
    """The format `workbooks`: rows of (book, sheet, cells ...), in order within a task."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options["path"], overwrite)


def write_workbooks(rows: DataFrame, path: str, sheet: str, order: Sequence[str], per_book: int = SHEETS_PER_BOOK) -> None:
    """Write rows as book-00000.xlsx and so on below path, which all executors share; what is there goes on commit.

    sheet is the rows' sheet number; a book has per_book of them and is written by one task, row by row. Rows of a sheet
    go by order (nulls last), which isn't written. Each sheet starts with the names of the other columns. No rows give no book.
    """
    rows.sparkSession.dataSource.register(Workbooks)
    cells = [F.col(c) for c in rows.columns if c != sheet and c not in order]
    by = [F.col("book_"), F.col("sheet_"), *(F.asc_nulls_last(c) for c in order)]
    dealt = rows.withColumn("sheet_", F.col(sheet).cast("int")).withColumn("book_", F.floor(F.col("sheet_") / per_book).cast("int"))
    dealt = dealt.repartition("book_").sortWithinPartitions(*by).select("book_", "sheet_", *cells)
    dealt.write.format("workbooks").mode("overwrite").option("path", path).save()


def _column(reference: str | None, at: int) -> int:
    """A cell's column from 0, by its reference if it has one."""
    if not reference:
        return at
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _texts(node: ElementTree.Element) -> str:
    """What a cell's or string's runs say together, without readings."""
    return decoded("".join(t.text or "" for run in node if not run.tag.endswith("}rPh") for t in run.iter() if t.tag.endswith("}t")))


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet name, row (from 0) and cells as texts of each row of a workbook, streamed from its parts."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = []
        if "xl/sharedStrings.xml" in book.namelist():
            for _, node in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if node.tag.endswith("}si"):
                    holder = ElementTree.Element("holder")
                    holder.extend(list(node))
                    strings.append(_texts(holder))
                    node.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{{{MAIN}}}sheet"):
            target = targets[sheet.get(f"{{{LINKS}}}id")]
            part = book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            n, top = 0, None
            for event, node in ElementTree.iterparse(part, events=("start", "end")):
                if event == "start":
                    top = node if node.tag.endswith("}sheetData") else top
                    continue
                if not node.tag.endswith("}row"):
                    continue
                cells: list[str | None] = []
                for c in node:
                    at = _column(c.get("r"), len(cells))
                    cells += [None] * (at + 1 - len(cells))
                    value = next((x.text for x in c if x.tag.endswith("}v")), None)
                    kind = c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(_texts(x) if len(x) else x.text or "" for x in c if x.tag.endswith("}is"))
                    elif value is not None:
                        cells[at] = strings[int(value)] if kind == "s" else {"0": "false", "1": "true"}[value] if kind == "b" else decoded(value)
                row = int(node.get("r") or n + 1) - 1
                yield sheet.get("name"), row, cells
                n = row + 1
                if top is not None:
                    top.clear()


def read_workbooks(spark: SparkSession, path: str, headers: Sequence[str]) -> DataFrame:
    """path_, sheet_, row_ and the columns under headers, as texts, of all rows of all sheets of the workbooks at path.

    A sheet's first row that isn't blank has its headers; blank rows are left out, a header that a sheet lacks gives nulls, of
    two alike the first counts, and other columns are left out. A workbook is parsed by one task, row by row.
    """
    names = ["path_", "sheet_", "row_", *headers]
    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * len(headers)]
    quoted = ", ".join(f"`{h}` string" for h in headers)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(held: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in held], t) for j, t in enumerate(kinds)], names)

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                held, at, now = [], None, None
                for sheet, row, cells in sheet_rows(content.as_py()):
                    if sheet != now:
                        now, at = sheet, None
                    if not any((c or "").strip() for c in cells):
                        continue
                    if at is None:
                        own = [(c or "").strip() for c in cells]
                        at = [own.index(h) if h in own else -1 for h in headers]
                        continue
                    held.append([file, sheet, row, *(cells[i] if 0 <= i < len(cells) else None for i in at)])
                    if len(held) == ROWS:
                        yield full(held)
                        held = []
                yield full(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").repartition("path")
    # Batches of files are bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch.
    return files.mapInArrow(parse, f"path_ string, sheet_ string, row_ long{', ' * bool(headers)}{quoted}")
