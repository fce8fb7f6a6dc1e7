"""SQLite tables: even parts, filters that reach the file, types, collations and generated columns."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.sources import files


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    found = str(tmp_path_factory.mktemp("lite") / "d.sqlite")
    with sqlite3.connect(found) as db:
        db.execute("CREATE TABLE gaps (k INTEGER PRIMARY KEY, v REAL, t TEXT)")
        db.executemany("INSERT INTO gaps VALUES (?, ?, ?)", [(i if i < 900 else i * 10**12, i / 4, f"t{i % 7}") for i in range(1000)])
        db.execute("CREATE TABLE odd (name TEXT COLLATE NOCASE NOT NULL, n INTEGER, w INTEGER GENERATED ALWAYS AS (n * 2) VIRTUAL, d DECIMAL(8,2), b BLOB, plain TEXT)")
        db.executemany("INSERT INTO odd (name, n, d, b, plain) VALUES (?, ?, ?, ?, ?)", [("A", 1, 1.25, b"\x01\xff", "A"), ("a", "x", "nan", None, "a"), ("É", 2**62, "12", "text", b"\x41"), ("b", 3.5, None, None, None)])
        db.execute("CREATE TABLE bare (a TEXT PRIMARY KEY, b INTEGER) WITHOUT ROWID")
        db.execute("INSERT INTO bare VALUES ('x', 1)")
    return found


def test_parts_have_equally_many_rows(spark, path):
    df = files.read_sqlite(spark, path, "gaps", 5)
    assert df.dtypes == [("k", "bigint"), ("v", "double"), ("t", "string")]
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sizes == [200] * 5 and df.select("k").distinct().count() == 1000
    assert files.read_sqlite(spark, path, "bare").collect() == [("x", 1)] and files.read_sqlite(spark, path, "gaps").count() == 1000


def test_types_collations_and_generated_columns(spark, path):
    df = files.read_sqlite(spark, path, "odd")
    assert [r["plain"] for r in df.where("name = 'a'").orderBy("plain").collect()] == ["A", "a"] and df.where("plain = 'a'").count() == 1
    assert not df.schema["name"].nullable and df.schema["plain"].nullable
    rows = {r["name"]: r for r in df.collect()}
    assert (rows["A"]["n"], rows["A"]["w"], str(rows["A"]["d"]), rows["A"]["b"]) == (1, 2, "1.250000", "01ff")
    assert (rows["a"]["n"], rows["a"]["d"], rows["É"]["n"], rows["É"]["plain"], rows["b"]["n"]) == (None, None, 2**62, "41", 3)
    assert {r["col"] for r in P.column_stats(df, "odd", ["name"]).collect()} == {"name", "n", "w", "d", "b", "plain"}


@pytest.mark.parametrize("test", ["k = 7", "k > 5 AND k <= 9", "t = 't3' AND v < 10", "k IN (1, 2, 3000)", "t IS NOT NULL AND v >= 249.5", "t LIKE 't1%' AND k = 8", "k <> 3 AND k < 5", "t = 'none'"])
def test_filters_change_nothing(spark, path, test):
    key, before = "spark.sql.python.filterPushdown.enabled", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    want = sorted(map(tuple, files.read_sqlite(spark, path, "gaps", 3).where(test).collect()))
    spark.conf.set(key, "true")
    try:
        assert sorted(map(tuple, files.read_sqlite(spark, path, "gaps", 3).where(test).collect())) == want
    finally:
        spark.conf.set(key, before)


def test_filters_reach_the_file(path):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, LessThan

    reader = files._FilteringReader({"path": path, "table": "gaps"}, files.sqlite_schema(path, "gaps"))
    asked = [EqualTo(("t",), "t3"), LessThan(("k",), 100), In(("v",), (0.75, 2.5)), IsNotNull(("t",)), EqualTo(("t",), 5)]
    assert list(reader.pushFilters(asked)) == asked and len(reader.where) == 4
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [3, 10]
    odd = files._FilteringReader({"path": path, "table": "odd"}, files.sqlite_schema(path, "odd"))
    list(odd.pushFilters([EqualTo(("name",), "a"), EqualTo(("n",), 1)]))  # a collated column's filter stays in the session
    assert len(odd.where) == 1 and {r[0] for p in odd.partitions() for r in odd.read(p)} == {"A", "a"}
