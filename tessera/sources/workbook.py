"""Workbooks as a data source: a task streams a sheet's zipped XML, row by row."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import naming

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of an Arrow batch.
ROWS = 4096


class _Strings:
    """A workbook's shared strings as one buffer with offsets, so that a string costs its bytes and eight more."""

    def __init__(self, z: zipfile.ZipFile):
        self.text, self.ends = bytearray(), array("q", [0])
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for item in _children(f, f"{_NS}si", f"{_NS}sst"):
                    self.text += _joined(item).encode()
                    self.ends.append(len(self.text))

    def __getitem__(self, i: int) -> str:
        return self.text[self.ends[i] : self.ends[i + 1]].decode()


def _joined(element: ET.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_NS}t"))


def _children(file, tag: str, parent: str) -> Iterator[ET.Element]:
    """Each element of a tag below a parent, which is emptied once the element has been used."""
    holder = None
    for event, element in ET.iterparse(file, events=("start", "end")):
        if event == "start" and element.tag == parent:
            holder = element
        elif event == "end" and element.tag == tag:
            yield element
            if holder is not None:
                holder.clear()


def _place(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheets(path: str) -> dict[str, str]:
    """The part of the archive that holds each sheet, by the sheet's name."""
    with zipfile.ZipFile(path) as z:
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = {s.get("name"): targets[s.get(_REL)] for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet")}
    return {name: part if part.startswith("xl/") else f"xl/{part}" for name, part in found.items()}


def sheet_rows(path: str, part: str) -> Iterator[list[str | None]]:
    """The rows of a sheet that are not blank, as texts; one row is held at a time."""
    with zipfile.ZipFile(path) as z:
        shared = None
        with z.open(part) as f:
            for row in _children(f, f"{_NS}row", f"{_NS}sheetData"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iter(f"{_NS}c")):
                    at = _place(c.get("r")) if c.get("r") else k
                    v = c.find(f"{_NS}v")
                    if c.get("t") == "inlineStr":
                        cells[at] = _joined(c)
                    elif v is not None and v.text is not None:
                        if c.get("t") == "s":
                            shared = shared or _Strings(z)
                            cells[at] = shared[int(v.text)]
                        else:
                            cells[at] = v.text
                if any(cells.values()):
                    yield [cells.get(i) for i in range(max(cells) + 1)]


class _SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.part, self.schema = options["path"], options["part"], schema

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.part)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()
        rows = sheet_rows(self.path, self.part)
        next(rows, None)
        held: list[list[str | None]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in held], pa.string()) for i in range(len(names))], names=names)

        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class WorkbookSource(DataSource):
    """One sheet, its first row that is not blank as header; options path and part."""

    @classmethod
    def name(cls) -> str:
        return "tessera_workbook"

    def schema(self) -> T.StructType:
        header = next(sheet_rows(self.options["path"], self.options["part"]), [])
        return T.StructType([T.StructField(n, T.StringType()) for n in naming.unique_headers("" if h is None else h for h in header)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SheetReader(self.options, schema)
