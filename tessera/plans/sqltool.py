"""Guarded SQL over an environment: read-only statements, a time limit, capped output, sources emptied at will."""

from __future__ import annotations

import re
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import statements
from tessera.plans.dialect import Dialect
from tessera.session import within

OUTPUT_CAP, TIMEOUT_S = 50_000, 30
_ALLOWED = re.compile(r"^\s*(select|with|values|show|describe|desc|explain)\b", re.IGNORECASE)
_DOT = re.compile(r"^\s*\.(tables|schema)\s*(\S*)\s*;?\s*$", re.IGNORECASE)
_PRAGMA = re.compile(r"^\s*pragma\s+table_(?:x)?info\s*\(\s*[\"'`]?(\w+)[\"'`]?\s*\)\s*;?\s*$", re.IGNORECASE)
_REFLECTED = frozenset(("reflect", "try_reflect", "java_method"))
_WRITES = frozenset("insert update delete merge create drop alter replace truncate load attach detach vacuum reindex from map reduce".split())


@dataclass
class ToolResult:
    tool: str
    success: bool
    stdout: str = ""
    stderr: str = ""
    truncated: bool = False
    elapsed_s: float = 0.0
    rows: list | None = None

    @property
    def output(self) -> str:
        return self.stdout if self.success else self.stderr

    @property
    def nonempty(self) -> bool:
        return self.success and bool(self.stdout.strip())


#: The longest numeric beginning of a text counts, and nothing numeric is 0.
_FUNCTIONS = (
    r"CREATE OR REPLACE TEMPORARY FUNCTION sqlite_real(x STRING) RETURNS DOUBLE RETURN CASE WHEN x IS NULL THEN NULL ELSE coalesce(try_cast(regexp_extract(x, r'^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0D) END",
    r"CREATE OR REPLACE TEMPORARY FUNCTION sqlite_integer(x STRING) RETURNS BIGINT RETURN CASE WHEN x IS NULL THEN NULL ELSE coalesce(try_cast(regexp_extract(x, r'^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0L) END",
)


def to_spark_sql(query: str, whole: frozenset[str] = frozenset(), text: frozenset[str] = frozenset()) -> str:
    """Catalog questions as the session's; other statements through the dialect, whole and text naming the columns of integers and of strings."""
    body = query.strip().rstrip(";").strip()
    if m := _DOT.match(body):
        return f"DESCRIBE TABLE {m[2]}" if m[1].lower() == "schema" and m[2] else "SHOW TABLES"
    if m := _PRAGMA.match(body):
        return f"DESCRIBE TABLE {m[1]}"
    if set(statements.facts(body).sources) & {"sqlite_master", "sqlite_schema"}:
        return "SHOW TABLES"
    return Dialect(whole, text).rewrite(body)


class Environment:
    """Tables under their names in a session of their own; others of the application do not see them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self._base, self.tables = spark, tables
        kinds = [(name.lower(), kind) for df in tables.values() for name, kind in df.dtypes]
        only = lambda wanted: frozenset(n for n, _ in kinds if all(k in wanted for m, k in kinds if m == n))
        self._whole, self._text = only(("tinyint", "smallint", "int", "bigint")), only(("string",))
        self._lock, self._emptied = threading.Lock(), {}
        self.session = self._session(None)

    def _session(self, gone: str | None) -> SparkSession:
        session = self._base.newSession()
        session.conf.set("spark.sql.runSQLOnFiles", "false")  # a path is not a table
        for function in _FUNCTIONS:
            session.sql(function)
        for name, df in self.tables.items():
            plan = df.where("false") if name == gone else df
            # the same logical plan under a view of the new session
            DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan._jdf.queryExecution().analyzed()), session).createOrReplaceTempView(name)
        return session

    def _without(self, gone: str) -> SparkSession:
        """The session in which a source is empty, made once."""
        with self._lock:
            if gone not in self._emptied:
                self._emptied[gone] = self._session(gone)
            return self._emptied[gone]

    def query(self, text: str, gone: str | None = None) -> DataFrame:
        """The plan of a read-only statement, one source emptied where named.

        A statement reads only if it can stand between parentheses, where the grammar has room
        for a query alone; a write behind WITH cannot. Explaining it parses it so and runs nothing.
        """
        found, sql = statements.facts(text), to_spark_sql(text, self._whole, self._text)
        cut = statements.tokens(text)
        calls = {t.name.lower() for t in cut}
        if not _ALLOWED.match(sql) or not statements.balanced(cut) or found.statements > 1 or found.verb in _WRITES or calls & _REFLECTED:
            raise PermissionError("only one reading statement is allowed")
        session = self.session if gone is None else self._without(gone)
        if re.match(r"\s*(select|with|values)\b", sql, re.IGNORECASE):
            try:
                session.sql(f"EXPLAIN SELECT * FROM ({sql}\n)")
            except ParseException as e:
                raise PermissionError("only one reading statement is allowed") from e
        return session.sql(sql)

    def execute_sql(self, text: str, timeout: float = TIMEOUT_S, cap: int = OUTPUT_CAP, gone: str | None = None) -> ToolResult:
        """Run a statement; rows beyond what the output cap can hold are not fetched. Overrunning jobs are cancelled."""
        began, context = time.monotonic(), self._base.sparkContext
        tag = f"sqltool-{uuid.uuid4().hex}"
        timer = threading.Timer(timeout, lambda: context.cancelJobsWithTag(tag))
        timer.daemon = True
        try:
            context.addJobTag(tag)
            timer.start()
            df = self.query(text, gone)
            rows = df.limit(cap // 2 + 1).collect()
            out = render(df.columns, rows)
            return ToolResult("execute_sql", True, out[:cap], "", len(out) > cap, time.monotonic() - began, rows)
        except Exception as e:
            return ToolResult("execute_sql", False, "", str(e)[:2000], False, time.monotonic() - began)
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    def list_tables(self) -> ToolResult:
        return ToolResult("list_tables", True, "\n".join(sorted(self.tables)))

    def table_schema(self, name: str) -> ToolResult:
        """cid, name, type, notnull of a table's columns; a data frame has neither defaults nor keys."""
        if name not in self.tables:
            return ToolResult("get_table_schema", False, "", f"no such table: {name}")
        fields = self.tables[name].schema.fields
        return ToolResult("get_table_schema", True, "\n".join(f"{i}|{f.name}|{f.dataType.simpleString().upper()}|{int(not f.nullable)}" for i, f in enumerate(fields)))

    def replay(self, text: str, gone: str | None, timeout: float = TIMEOUT_S) -> str | None:
        """A digest of a statement's rows, with a source emptied where named; None where it fails or takes too long.

        The digest is of typed rows, whatever their order, and of all of them: their number and two
        sums of hashes. Reals count to nine digits, as sums differ beyond by the order of adding.
        """
        try:
            return within(self._base, timeout, lambda: digest(self.query(text, gone)))
        except Exception:
            return None


def digest(df: DataFrame) -> str:
    """The digest of a result, from one aggregation over all of its rows."""
    cells = [F.format_string("%.8e", c.cast("double")) if kind in ("double", "float") else c.cast("string") for c, kind in ((F.col(f"`{n}`"), kind) for n, kind in df.toDF(*[f"c{i}" for i in range(len(df.columns))]).dtypes)]
    row = F.to_json(F.array(*[F.concat(F.lit(kind + ":"), F.coalesce(c, F.lit("\x00"))) for c, (_, kind) in zip(cells, df.dtypes)]))
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(row.alias("row"))
    found = named.agg(F.count(F.lit(1)).alias("n"), total(F.xxhash64("row")).alias("a"), total(F.xxhash64(F.lit(7), "row")).alias("b")).first()
    return f"{found['n']}:{found['a']}:{found['b']}"


def render(columns: list[str], rows: list) -> str:
    """Header and rows, fields parted by bars, nulls empty."""
    if not rows:
        return ""
    return "\n".join(["|".join(columns), *("|".join("" if v is None else str(v) for v in r) for r in rows)])
