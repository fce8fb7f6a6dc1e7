"""The driver's contract: names, columns, and results against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return db


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderstatus", "n"] and entry.entry(spark).count()


def canonical(rows, order):
    text = lambda v: "None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v).replace(" 00:00:00", "")
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n in core.queries() if n in core.oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    found = duck.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    columns = sorted(df.columns)
    mine = canonical([tuple(r) for r in df.collect()], [df.columns.index(c) for c in columns])
    theirs = canonical(found.fetchall(), [found.columns.index(c) for c in columns])
    assert mine == theirs


def test_nothing_imports_the_corpus_subpackage():
    root = Path(core.__file__).parent
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "tessera.llm" in p.read_text()]
