"""Delimited text by ranges against the reader that gives a file to one task."""

import random
from collections import Counter

import pytest

from tessera.sources import delimited, files


def one_task(spark, path, names, sep):
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, sep=sep, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "50", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(draw):
    kind = draw.randrange(7)
    plain = "".join(draw.choice("abc é") for _ in range(draw.randrange(1, 6))).strip() or "z"
    if kind < 3:
        return plain
    if kind == 3:
        return ""
    if kind == 4:
        return plain + '"' + plain  # a quote within a bare field is a letter
    body = "".join(draw.choice(["a", ",", "\n", "\n\n", "\r\n", '""', "xyz", " "]) for _ in range(draw.randrange(0, 12 if kind == 5 else 60)))
    return f'"{body}"'


@pytest.mark.parametrize(("seed", "sep", "end"), [(1, ",", "\n"), (2, "\t", "\n"), (3, ",", "\r\n"), (4, ",", "\n")])
def test_ranges_equal_one_task(small_ranges, tmp_path, seed, sep, end):
    spark, draw = small_ranges, random.Random(seed)
    for k in range(3):
        rows = [sep.join(cell(draw).replace(",", sep) for _ in range(3)) for _ in range(60)]
        head = f'"a{chr(10) * (40 if seed == 4 else 0)}x"{sep}b{sep}c'
        (tmp_path / f"f{k}.csv").write_bytes((head + end + end.join(rows) + (end if k else "")).encode())
    path, names = str(tmp_path), ["a", "b", "c"]
    found = delimited.read(spark, path, names, sep)
    plain = lambda r: tuple("" if v is None else v.replace("\r\n", "\n") for v in r)
    got = Counter(t for t in map(plain, found.collect()) if any(t))
    want = Counter(t for t in map(plain, one_task(spark, path, names, sep).collect()) if any(t))
    assert got == want and sum(got.values()) > 100
    assert spark.read.text(path).rdd.getNumPartitions() > 20


def test_a_field_over_many_ranges_and_an_open_quote(small_ranges, tmp_path):
    spark = small_ranges
    (tmp_path / "a.csv").write_text('k,v\n1,"' + "line\n" * 100 + '"\n2,x\n3,"never closed\n4,y\n' + "z\n" * 50)
    rows = sorted(map(tuple, delimited.read(spark, str(tmp_path / "a.csv"), ["k", "v"]).collect()))
    assert rows[0] == ("1", "line\n" * 100) and rows[1] == ("2", "x") and rows[2][0] == "3" and len(rows) == 3


def test_states_of_lines():
    lines = [("a,b", False, False), ('a,"b', False, True), ('b",c', True, False), ('a""b', True, True), ('""",x', True, False), ('x","y', True, True), ('5" disk,b', False, False), ('"a""', False, True), ("", True, True), ('""', False, False)]
    for line, before, after in lines:
        assert delimited.state_after(line, before, ",") is after, line


def test_the_reader_uses_ranges(small_ranges, tmp_path):
    (tmp_path / "t.csv").write_text("id,note,Note\n" + "".join(f'{i},"n\n{i}",{i / 2}\n' for i in range(80)) + ",,\n")
    df = files.read_delimited(small_ranges, str(tmp_path / "t.csv"))
    assert [k for _, k in df.dtypes] == ["bigint", "string", "double"]
    assert df.count() == 80 and df.where("id = 7").first()[1] == "n\n7" and df.rdd.getNumPartitions() > 5
