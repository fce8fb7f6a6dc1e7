"""Readers by format: delimited text, SQLite, workbooks, Markdown, Parquet."""

from __future__ import annotations

import itertools
import math
import os
import re
import sqlite3
import urllib.parse
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tessera.session import durable
from tessera.sources import delimited, naming, workbook
from tessera.sources.infer import facts, infer_types, typed

MOST_TABLES = 40
#: Rows of an SQLite table that one task reads.
ROWS_A_PART = 250_000
FAMILIES = {
    ".sqlite": "sqlite", ".db": "sqlite", ".sqlite3": "sqlite", ".csv": "csv", ".tsv": "csv", ".xlsx": "excel", ".xlsm": "excel", ".xls": "excel",
    ".md": "markdown", ".markdown": "markdown", ".parquet": "parquet",
}


def family(path: str) -> str | None:
    """The format of a file by its suffix; None for files that are skipped."""
    return next((f for s, f in FAMILIES.items() if path.lower().endswith(s)), None)


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV file: first row header, all values text, then types by all values. A file needs a header and a row.

    Only the header is read by one task; rows are cut by ranges, with line breaks in quoted fields.
    """
    separator = "\t" if path.lower().endswith(".tsv") else ","
    raw = spark.read.csv(path, sep=separator, header=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8", inferSchema=False)
    first = raw.first()
    if first is None:
        raise ValueError(f"{path} has no rows")
    names = naming.unique_headers(["" if v is None else v for v in first])
    table = delimited.read(spark, path, names, separator)
    present = F.lit(False)
    for n in names:
        present = present | (F.coalesce(F.col(f"`{n}`"), F.lit("")) != "")
    return infer_types(table.where(present))


# SQLite, by ranges of equally many rows


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    """Typed columns of a table, in parts of equally many rows whatever gaps its rowids have."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table = options["path"], options["table"]
        self.parts, self.rows = int(options.get("partitions", 0)), int(options.get("rows", ROWS_A_PART))
        self.schema, self.where, self.bound = schema, [], []

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            try:
                count = db.execute(f"SELECT count(rowid) FROM {_quoted(self.table)}").fetchone()[0]
            except sqlite3.Error:  # no rowid: one part
                return [_Range(None, None)]
            parts = max(1, min(count, self.parts or -(-count // self.rows)))
            starts = [db.execute(f"SELECT rowid FROM {_quoted(self.table)} ORDER BY rowid LIMIT 1 OFFSET ?", (count * k // parts,)).fetchone() for k in range(1, parts)]
        lows = [None, *(r[0] for r in starts)]
        return [_Range(low, high) for low, high in zip(lows, [*lows[1:], None])]

    def read(self, part: _Range) -> Iterator[tuple]:
        where, bound = list(self.where), list(self.bound)
        for test, value in (("rowid >= ?", part.low), ("rowid < ?", part.high)):
            if value is not None:
                where.append(test)
                bound.append(value)
        kinds = [f.dataType for f in self.schema.fields]
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields) or "1"
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            for row in db.execute(f"SELECT {columns} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), bound):
                yield tuple(_typed(v, k) for v, k in zip(row, kinds))


class _FilteringReader(_SqliteReader):
    """Filters reach SQLite where they leave out nothing that the session would keep; the session tests every row again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self._push(f)
            yield f

    def _push(self, f: Filter) -> None:
        name = ".".join(getattr(f, "attribute", ()))
        kind = next((x.dataType for x in self.schema.fields if x.name == name), None)
        plain = isinstance(kind, (T.LongType, T.DoubleType)) or kind == T.StringType()
        ops = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        # what is not stored as declared is left for the session to judge
        other = f"typeof({_quoted(name)}) {'NOT IN (' + chr(39) + 'integer' + chr(39) + ', ' + chr(39) + 'real' + chr(39) + ')' if not isinstance(kind, T.StringType) else '<> ' + chr(39) + 'text' + chr(39)}"
        fits = lambda v: isinstance(v, str) if isinstance(kind, T.StringType) else isinstance(v, (int, float)) and not isinstance(v, bool)
        if plain and type(f) in ops and fits(f.value):
            self.where.append(f"({_quoted(name)} {ops[type(f)]} ? OR {other})")
            self.bound.append(f.value)
        elif plain and isinstance(f, In) and 0 < len(f.value) <= 500 and all(map(fits, f.value)):
            self.where.append(f"({_quoted(name)} IN ({', '.join('?' * len(f.value))}) OR {other})")
            self.bound += f.value
        elif kind is not None and isinstance(f, IsNotNull):
            self.where.append(f"{_quoted(name)} IS NOT NULL")


def _typed(value: object, kind: T.DataType) -> object:
    """A stored value as its column's type, null where it does not fit."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.LongType):
            whole = int(value) if not isinstance(value, float) else int(value) if math.isfinite(value) else None
            return whole if whole is not None and -(1 << 63) <= whole < 1 << 63 else None
        if isinstance(kind, T.DoubleType):
            return float(value)
        if isinstance(kind, T.DecimalType):
            number = Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
            return number if number.is_finite() and number.adjusted() < kind.precision - kind.scale else None
    except (ValueError, TypeError, ArithmeticError):
        return None
    return value.hex() if isinstance(value, bytes) else str(value)


class SqliteSource(DataSource):
    """format("tessera_sqlite") with options path, table, partitions or rows a part, and filters (true where the session hands them on)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_sqlite"

    def schema(self) -> T.StructType:
        return sqlite_schema(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("filters", "false").lower() == "true" else _SqliteReader
        return kind(dict(self.options), schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_columns(path: str, table: str) -> list[tuple[str, str, bool]]:
    """name, declared type, nullable; hidden columns are left out and generated ones kept."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [(r[1], r[2] or "TEXT", not r[3]) for r in db.execute(f"PRAGMA table_xinfo({_quoted(table)})") if r[6] != 1]


def sqlite_schema(path: str, table: str) -> T.StructType:
    """The typed schema of a table: what must not be null is not, and text that SQLite compares without case is so here."""
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "decimal(38,6)": T.DecimalType(38, 6)}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        made = db.execute("SELECT sql FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone()
    fields = []
    for name, declared, nullable in sqlite_columns(path, table):
        caseless = re.search(rf"(?i)(?:^|[(,\s])[\"`\[]?{re.escape(name)}[\"`\]]?\s[^,]*\bCOLLATE\s+NOCASE\b", made[0] if made and made[0] else "")
        kind = kinds.get(spark_type(declared), T.StringType("UTF8_LCASE") if caseless else T.StringType())
        # a value that does not fit a declared number is null here, so only text keeps its promise
        fields.append(T.StructField(name, kind, nullable or not isinstance(kind, T.StringType)))
    return T.StructType(fields)


def sqlite_tables(path: str, most: int = MOST_TABLES) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name LIMIT ?", (most,))]


def sqlite_foreign_keys(path: str, table: str) -> list[tuple[str, str, str]]:
    """(own column, other table, its column); a key that names no column means the other's primary key."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        out = []
        for r in db.execute(f"PRAGMA foreign_key_list({_quoted(table)})").fetchall():
            to = r[4]
            if to is None:
                to = next((c[1] for c in db.execute(f"PRAGMA table_info({_quoted(r[2])})") if c[5]), None)
            if to:
                out.append((r[3], r[2], to))
        return out


def spark_type(declared: str) -> str:
    """The Spark type of a declared SQLite type."""
    up = declared.upper()
    if "INT" in up:
        return "bigint"
    if any(x in up for x in ("REAL", "FLOA", "DOUB")):
        return "double"
    if any(x in up for x in ("DEC", "NUM")):
        return "decimal(38,6)"
    return "string"


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int | None = None) -> DataFrame:
    """A table with its declared types; values that do not fit them are null.

    Filters reach SQLite where the session's spark.sql.python.filterPushdown.enabled is true.
    """
    spark.dataSource.register(SqliteSource)
    options = {"path": path, "table": table, "filters": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    return spark.read.format("tessera_sqlite").options(**options, **({"partitions": partitions} if partitions else {})).load()


# Workbooks


def read_workbook(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every sheet of two rows or more as a table; empty header cells become col.

    A task streams a sheet once, into a table of texts in the shared folder, whose types follow
    from all values. The driver reads the first two rows. Sheets of a workbook are one after another.
    """
    spark.dataSource.register(workbook.WorkbookSource)
    out = {}
    for name, part in workbook.sheets(path).items():
        if len(list(itertools.islice(workbook.sheet_rows(path, part), 2))) == 2:
            out[name] = infer_types(durable(spark.read.format("tessera_workbook").options(path=path, part=part).load()))
    return out


# Markdown: fixed patterns of lines

PIPE_ROW = re.compile(r"^\s*\|(.+)\|\s*$")
RULE_ROW = re.compile(r"^\s*\|?\s*:?-{3,}:?(\s*\|\s*:?-{3,}:?)*\s*\|?\s*$")
KEY_LINE = re.compile(r"^\s*([A-Za-z][A-Za-z0-9_ ]{0,40}?)\s*:\s*(.+?)\s*$")
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def pipe_tables(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """Header and rows of each pipe table: a header line, a rule, and two rows or more with as many cells."""
    out, header, rows, pending = [], None, [], None
    for line in [*(text or "").splitlines(), ""]:
        row = PIPE_ROW.match(line)
        if header is not None:
            if row:
                cells = _cells(line)
                if len(cells) == len(header):
                    rows.append(cells)
                continue
            if len(rows) >= 2:
                out.append((header, rows))
            header, rows = None, []
        if pending is not None and RULE_ROW.match(line):
            header, pending = _cells(pending), None
        else:
            pending = line if row else None
    return out


def key_blocks(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """Key-value lines as a table of section, key, value (from three lines on), and as one of records.

    A record ends at a blank line, a heading, or a key that it has already. Keys that three
    records hold make the columns, of which two are needed, and two records must hold all.
    """
    section, lines, records = "_root", [], [{}]
    for line in (text or "").splitlines():
        if m := HEADING.match(line):
            section = m[2].strip() or "_root"
            records.append({})
        elif m := KEY_LINE.match(line):
            key = naming.safe_identifier(m[1])
            lines.append([section, key, m[2]])
            if key in records[-1]:
                records.append({})
            records[-1][key] = m[2]
        elif not line.strip():
            records.append({})
    out = [(["section", "key", "value"], lines)] if len(lines) >= 3 else []
    records = [r for r in records if r]
    counts = {k: sum(k in r for r in records) for r in records for k in r}
    columns = [k for k, n in counts.items() if n >= 3]
    whole = [[r[k] for k in columns] for r in records if all(k in r for k in columns)]
    if len(records) >= 3 and len(columns) >= 2 and len(whole) >= 2:
        out.append((columns, whole))
    return out


@F.udtf(returnType="block int, row_idx int, cells array<string>")
class BlockRows:
    """Rows of all blocks of a text, pipe tables before key lines; row 0 is the header."""

    def eval(self, text: str):
        for b, (header, rows) in enumerate(pipe_tables(text) + key_blocks(text)):
            for i, cells in enumerate([header, *rows]):
                yield b, i, cells


def markdown_blocks(texts: DataFrame) -> dict[tuple[str, int], DataFrame]:
    """Every block of many texts (path, text) as a typed table, by path and number; rows without any value are left out.

    The texts are walked once, on the executors. The driver gets the headers and, for each
    column, what decides its type. A path that is not unique, a null text or one without blocks has none.
    """
    rows = durable(texts.select("path", "text").lateralJoin(BlockRows(F.col("text").outer())).drop("text"))
    body = rows.where((F.col("row_idx") > 0) & F.exists("cells", lambda c: c != ""))
    each = body.select("path", "block", F.posexplode("cells").alias("at", "value"))
    seen = {(r["path"], r["block"], r["at"]): r["facts"] for r in each.groupBy("path", "block", "at").agg(facts(F.col("value")).alias("facts")).collect()}
    nothing = {"n": 0}
    out = {}
    for path, block, header in rows.where("row_idx = 0").select("path", "block", "cells").orderBy("path", "block").collect():
        own = body.where(F.col("path").eqNullSafe(path) & (F.col("block") == block))
        out[path, block] = own.select(*(typed(F.col("cells")[i], seen.get((path, block, i), nothing)).alias(n) for i, n in enumerate(naming.unique_headers(header))))
    return out


def read_markdown(spark: SparkSession, *paths: str) -> dict[str, dict[str, DataFrame]]:
    """For each file every block as a table, named by its number."""
    texts = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    named = {p if "://" in p else os.path.abspath(p): p for p in paths}
    out: dict[str, dict[str, DataFrame]] = {p: {} for p in paths}
    for (uri, block), df in markdown_blocks(texts).items():
        local = urllib.parse.unquote(urllib.parse.urlsplit(uri).path)
        out[named.get(urllib.parse.unquote(uri)) or named[local]][str(block)] = df
    return out


@F.udtf(returnType="table_idx int, row_idx int, cells array<string>")
class PipeTableRows:
    """Rows of all pipe tables of a text; row 0 is the header."""

    def eval(self, text: str):
        for t, (header, rows) in enumerate(pipe_tables(text)):
            for i, cells in enumerate([header, *rows]):
                yield t, i, cells


@F.udtf(returnType="section string, key string, value string")
class KeyLines:
    """Key-value lines of a text with their section, from three lines on."""

    def eval(self, text: str):
        for header, rows in key_blocks(text):
            if header == ["section", "key", "value"]:
                for section, key, value in rows:
                    yield section, key, value
