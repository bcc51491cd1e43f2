"""Workbooks with rich text, as XLSX files in a binary column. Standard library only.

A workbook is one file, so its rows meet in one task; give each document or batch of documents a workbook of its own. They pass through that
task in order, a batch at a time, into the compressed file and out of it: no task holds a workbook's rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Namespaces and parts of the format, and its greatest number of rows in a sheet.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/"
MAX_ROWS = 1_048_576
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Characters that XML cannot hold.
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
SPANS = "array<struct<text:string,highlighted:boolean,color:string>>"
CELLS = "sheet string, row int, column int, text string, color string"
#: Runs of text in a batch that is read.
RUNS = 10_000


def column_name(i: int) -> str:
    """A, B ... Z, AA ... of a column from 0."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _run(span: dict) -> str:
    look = f'<rPr><color rgb={quoteattr(span["color"])}/></rPr>' if span.get("color") else ""
    return f'<r>{look}<t xml:space="preserve">{escape(FORBIDDEN.sub("", span["text"] or ""))}</t></r>'


class Book:
    """A file that is written row by row, sheet after sheet."""

    def __init__(self) -> None:
        self.out, self.names, self.part, self.rows = io.BytesIO(), [], None, 0
        self.zip = zipfile.ZipFile(self.out, "w")

    @staticmethod
    def _entry(name: str) -> zipfile.ZipInfo:
        info = zipfile.ZipInfo(name)
        info.compress_type = zipfile.ZIP_DEFLATED
        return info

    def begin(self, name: str) -> None:
        self._end()
        self.names.append(name)
        self.rows = 0
        self.part = self.zip.open(self._entry(f"xl/worksheets/sheet{len(self.names)}.xml"), "w", force_zip64=True)
        self.part.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())

    def add(self, cells: list[list[dict] | None]) -> None:
        """A row of cells, each a list of spans (text and, where it is shown in a colour, color) or None."""
        self.rows += 1
        if self.rows > MAX_ROWS:
            raise ValueError(f"a sheet has at most {MAX_ROWS} rows")
        shown = "".join(f'<c r="{column_name(c)}{self.rows}" t="inlineStr"><is>{"".join(map(_run, spans))}</is></c>' for c, spans in enumerate(cells) if spans)
        self.part.write(f'<row r="{self.rows}">{shown}</row>'.encode())

    def _end(self) -> None:
        if self.part:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()

    def content(self) -> bytes:
        """Ends the file."""
        self._end()
        part = lambda tag, name, kind, i: f'<{tag} Id="rId{i}" Type="{RELS}/{kind}" Target="{name}"/>'
        files = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(self.names) + 1)) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}relationships">{part("Relationship", "xl/workbook.xml", "officeDocument", 1)}</Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets>' + "".join(f'<sheet name={quoteattr(FORBIDDEN.sub("", n))} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(self.names, 1)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}relationships">' + "".join(part("Relationship", f"worksheets/sheet{i}.xml", "worksheet", i) for i in range(1, len(self.names) + 1)) + "</Relationships>",
        }
        for name, text in files.items():
            self.zip.writestr(self._entry(name), HEAD + text)
        self.zip.close()
        return self.out.getvalue()


def cells_of(data: bytes | None) -> Iterator[dict]:
    """The runs of every cell of a file that a Book wrote, in order."""
    if not data:
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")]
        for i, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml") as part:
                held = None
                for event, x in ET.iterparse(part, ("start", "end")):
                    if event == "start":
                        held = x if x.tag == f"{{{MAIN}}}sheetData" else held
                    elif x.tag == f"{{{MAIN}}}row":
                        for c in x.iter(f"{{{MAIN}}}c"):
                            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                            column = 0
                            for letter in letters:
                                column = column * 26 + ord(letter) - 64
                            for r in c.iter(f"{{{MAIN}}}r"):
                                color = r.find(f"{{{MAIN}}}rPr/{{{MAIN}}}color")
                                yield {"sheet": name, "row": int(row), "column": column - 1, "text": r.findtext(f"{{{MAIN}}}t") or "", "color": None if color is None else color.get("rgb")}
                        held.clear()  # what is read is not kept


def read_cells(data: bytes | None) -> list[dict]:
    return list(cells_of(data))


def workbooks(rows: DataFrame, book: str, sheet: str, order: list[str], columns: list[str], header: bool = True) -> DataFrame:
    """book and content (the file): one row per workbook. rows: book, sheet (its name, unique in the book), columns by which a sheet's rows
    are ordered, and the columns that are shown: text, or arrays of spans as rich_spans() gives. Nulls are empty cells; sheets are in
    order of their names, and a sheet without a name is called Sheet. An empty table gives no workbook."""
    text = lambda c: c if rows.schema[c].dataType.simpleString().startswith("array<struct<") else None
    plain = lambda c: F.when(F.col(c).isNotNull(), F.array(F.struct(F.col(c).cast("string").alias("text"), F.lit(False).alias("highlighted"), F.lit(None).cast("string").alias("color"))))
    cells = F.array(*[F.col(c).cast(SPANS) if text(c) else plain(c).cast(SPANS) for c in columns])
    named = F.coalesce(F.nullif(F.col(sheet).cast("string"), F.lit("")), F.lit("Sheet"))
    dealt = rows.select(F.col(book).alias("book"), named.alias("sheet"), F.struct(*order).alias("o"), cells.alias("cells")).repartition("book")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, key, on = None, None, None
        whole = lambda: pa.RecordBatch.from_arrays([key, pa.array([file.content()], pa.binary())], ["book", "content"])
        for b in batches:
            books = b.column(0).to_pylist()
            for name, shown, line in zip(books, b.column(1).to_pylist(), b.column(2).to_pylist()):
                if file is None or key[0].as_py() != name:
                    if file is not None:
                        yield whole()
                    file, key, on = Book(), pa.array([name], b.column(0).type), None
                if on != shown:
                    file.begin(shown)
                    on = shown
                    if header:
                        file.add([[{"text": c}] for c in columns])
                file.add(line)
        if file is not None:
            yield whole()

    kind = T.StructType([T.StructField("book", rows.schema[book].dataType), T.StructField("content", T.BinaryType())])
    return dealt.sortWithinPartitions("book", "sheet", "o", "cells").select("book", "sheet", "cells").mapInArrow(made, kind)


def workbook_cells(books: DataFrame, content: str = "content") -> DataFrame:
    """The other columns, and one row per run of text: sheet, row (from 1), column (from 0), text, color."""
    others = [c for c in books.columns if c != content]
    kind = pa.schema([("sheet", pa.string()), ("row", pa.int32()), ("column", pa.int32()), ("text", pa.string()), ("color", pa.string())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                runs = cells_of(b.column(len(others))[i].as_py())
                while some := list(islice(runs, RUNS)):
                    found = pa.RecordBatch.from_pylist(some, kind)
                    same = [b.column(k).slice(i, 1).take(pa.array([0] * len(some))) for k in range(len(others))]
                    yield pa.RecordBatch.from_arrays([*same, *found.columns], [*others, *kind.names])

    fields = [f"`{c}` {books.schema[c].dataType.simpleString()}" for c in others]
    return books.select(*others, content).mapInArrow(cells, ", ".join([*fields, CELLS]))
