"""Statements told apart by hand, and answered as SQLite answers them."""

import sqlite3

import pytest

from tessera.plans import statements
from tessera.plans.sqltool import Environment, to_spark_sql

# statement, sources, numbers, shaped, verb
FACTS = [
    ("SELECT a FROM t", ["t"], [], False, "select"),
    ("select * from main.t x, u as y where x.k = 5", ["t", "u"], [5], True, "select"),
    ("WITH t AS (SELECT 1 AS a FROM s) SELECT a FROM t", ["s"], [1], False, "select"),
    ("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c), d AS (SELECT n FROM c) SELECT n FROM d JOIN e USING (n)", ["e"], [1, 1], True, "select"),
    ("SELECT 'from t2 where 7' AS w, \"from\" FROM t -- from t3 join t4\n/* from t5 limit 9 */", ["t"], [], False, "select"),
    ("SELECT t.a, u FROM x AS t LIMIT 5, 10", ["x"], [], True, "select"),
    ("SELECT a FROM (SELECT b AS a FROM y) AS z ORDER BY 1", ["y"], [1], False, "select"),
    ("SELECT a FROM p LEFT JOIN (q CROSS JOIN r) ON p.k = q.k", ["p", "q", "r"], [], True, "select"),
    ("SELECT a FROM p WHERE k IN (SELECT k FROM o WHERE v > 1.5e2)", ["p", "o"], [150], True, "select"),
    ("SELECT extract(year FROM d), a IS DISTINCT FROM b, count(*) FROM t", ["t"], [], True, "select"),
    ("SELECT countries, summary FROM counts", ["counts"], [], False, "select"),
    ("SELECT value FROM json_each('[1]'), \"odd name\"", ["odd name"], [], False, "select"),
    ("SELECT (SELECT max(v) FROM m) AS top FROM n, (WITH w AS (SELECT 3) SELECT * FROM w) AS v", ["m", "n"], [3], True, "select"),
    ("WITH w AS (SELECT 1 FROM a) INSERT INTO b SELECT * FROM w", ["a"], [1], False, "insert"),
    ("EXPLAIN INSERT INTO b SELECT * FROM a", ["a"], [], False, "insert"),
    ("EXPLAIN QUERY PLAN SELECT 0x10 FROM a", ["a"], [16], False, "select"),
    ("SELECT 1; DELETE FROM a", [], [1], False, "delete"),
    ("SELECT t.a FROM t WHERE t.a BETWEEN 1 AND 2 UNION SELECT b FROM u", ["t", "u"], [1, 2], True, "select"),
    ("((SELECT a FROM t))", ["t"], [], False, "select"),
    ("SELECT DISTINCT a FROM t", ["t"], [], True, "select"),
    ("", [], [], False, ""),
    ("SELECT ((a FROM t", ["t"], [], False, "select"),
]


@pytest.mark.parametrize(("sql", "sources", "numbers", "shaped", "verb"), FACTS)
def test_facts(sql, sources, numbers, shaped, verb):
    f = statements.facts(sql)
    if sql != "SELECT ((a FROM t":  # no SELECT stands in the inner parentheses
        assert f.sources == sources
    assert (f.numbers, f.shaped, f.verb) == (numbers, shaped, verb)


def test_facts_of_a_column(spark):
    df = spark.createDataFrame([(k, s) for k, (s, *_) in enumerate(FACTS)] + [(99, None)], "k int, sql string").repartition(3)
    got = {r["k"]: (r["f"]["numbers"], r["f"]["shaped"], r["f"]["verb"]) for r in df.select("k", statements.statement_facts("sql").alias("f")).collect()}
    assert got == {k: (n, s, v) for k, (_, _, n, s, v) in enumerate(FACTS)} | {99: ([], False, "")}


ROWS = [(1, "ann", "10", 1.5, "2024-02-29", "x"), (2, "Bob", "abc", 2.5, "2023-12-31", "x"), (3, "cy_d", None, -4.0, "2024-07-01", "y"), (4, "a*b?", "7 days", None, None, "y"), (-7, "", "-3", 0.0, "2024-01-01 05:06:07", None)]
QUERIES = [
    "SELECT (k + 1) / 2, k / 2, -7 / 2, 7 / -2, (k + 1.0) / 2, k * 3 / 2 % 4, count(*) / 2 FROM t GROUP BY k",
    "SELECT k / 0, k % 0, 1.5 / 0 FROM t",
    "SELECT sum(k) / count(*), max(k) / 2, length(name) / 2, (SELECT count(*) FROM t) / 2 FROM t GROUP BY name",
    "SELECT 7 / 2 / 2, 1 + 7 / 2 - 3, 10 - k / 2 FROM t",
    "SELECT CASE WHEN k > 1 THEN 5 ELSE 7 END / 2, abs(k) / 2, cast(v AS INTEGER) / 2, coalesce(k, 0) / 3 FROM t",
    "SELECT name FROM t WHERE name GLOB 'a*'",
    "SELECT name FROM t WHERE name NOT GLOB '*[b_]*' OR name GLOB 'a[*]b[?]'",
    "SELECT strftime('%Y-%m', d), strftime('%d', d), strftime('%w', d), strftime('%j', d) FROM t WHERE d IS NOT NULL",
    "SELECT strftime('%H:%M:%S', d) FROM t WHERE k = -7",
    "SELECT k FROM t WHERE 'abc' = 0 OR txt = 10",
    "SELECT k FROM t WHERE txt <> 10",
    "SELECT k FROM t WHERE k = '3' OR k = 'abc' OR k < '2'",
    "SELECT name, max(k) FROM t",
    "SELECT g, name, min(v) AS low FROM t WHERE v IS NOT NULL GROUP BY g",
    "SELECT g, count(*) AS n FROM t GROUP BY g HAVING n > 1",
    "SELECT max(k, 2), min(v, 0.5), min(k, 3, 2) / 2 FROM t",
    "SELECT total(v), sum(txt), avg(txt), count(txt) FROM t",
    "SELECT cast(txt AS INTEGER), cast(txt AS REAL), cast(k AS TEXT) || 'x' FROM t WHERE txt IS NOT NULL",
    "SELECT k FROM t WHERE name LIKE 'B%' -- a ; in a comment",
    "SELECT k FROM t ORDER BY k LIMIT 1, 2",
    "WITH w AS (SELECT k / 2 AS h FROM t) SELECT h, count(*) FROM w GROUP BY h",
    "SELECT 'it''s', 'back\\slash', \"name\" FROM t WHERE 1",
    "SELECT k FROM t WHERE 0",
    "SELECT k, row_number() OVER (ORDER BY k) / 2 FROM t",
    "SELECT k FROM t WHERE k NOT IN (1, 2) AND NOT EXISTS (SELECT 1 FROM t AS u WHERE u.k = t.k + 1)",
    "SELECT julianday(d) FROM t WHERE k = 3",
]


@pytest.fixture(scope="module")
def environment(spark):
    df = spark.createDataFrame(ROWS, "k int, name string, txt string, v double, d string, g string")
    return Environment(spark, {"t": df})


@pytest.fixture(scope="module")
def lite():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (k INTEGER, name TEXT, txt TEXT, v REAL, d TEXT, g TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", ROWS)
    return db


@pytest.mark.parametrize("sql", QUERIES)
def test_answers_are_those_of_sqlite(environment, lite, sql):
    result = environment.execute_sql(sql)
    assert result.success, (result.stderr, to_spark_sql(sql, environment._whole, environment._text))
    want = [tuple(r) for r in lite.execute(sql).fetchall()]
    got = [tuple(r) for r in result.rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("sql", ["EXPLAIN INSERT INTO t SELECT * FROM t", "SELECT 1; SELECT 2", "WITH w AS (SELECT 1) INSERT INTO t SELECT * FROM w", "DROP TABLE t", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT `reflect`('a', 'b')", "INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT 1"])
def test_writes_and_calls_are_refused(environment, sql):
    result = environment.execute_sql(sql)
    assert not result.success and not result.rows
