"""Readers, naming and types."""

import sqlite3
import zipfile

import pytest

from tessera.sources import environment, files, naming
from tessera.sources.infer import from_rows


def test_names():
    assert naming.unique_headers(["a b", "A_B", "", "a b"]) == ["a_b", "A_B_1", "col", "a_b_2"]
    taken = {"t"}
    assert naming.reserve("T", "csv", taken) == "T_csv" and naming.reserve("t", "csv", taken) == "t_csv_1"
    assert len(naming.unit_id("a", "b")) == 10 and files.family("x.MD") == "markdown" and files.family("x.txt") is None


def test_types(spark):
    df = from_rows(spark, ["i", "r", "t", "blank", "big"], [["1", "1.5", "x", "", "1" * 30], [" 2 ", "2e3", "1", None, "2"], ["", "", "", "", ""], ["3"], ["4", "1", "y", "", "3", "extra"]])
    assert dict(df.dtypes) == {"i": "bigint", "r": "double", "t": "string", "blank": "string", "big": "decimal(38,0)"}
    assert df.count() == 4


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,Name\n1,"x, ""y""\nz",q\n2,b\n,,\n')
    df = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name", "Name_1"] and [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'x, "y"\nz', "q"), (2, "b", None)]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    with sqlite3.connect(path) as db:
        db.executescript("CREATE TABLE parent(pid INTEGER PRIMARY KEY, label TEXT); CREATE TABLE child(cid INTEGER, ref INTEGER REFERENCES parent, x REAL, y AS (x * 2)); INSERT INTO parent VALUES (1, 'a'), (2, 'b'); INSERT INTO child VALUES (1, 1, 1.5), (2, 2, NULL)")
    child = files.read_sqlite(spark, path, "child")
    assert [tuple(r)[:3] for r in child.orderBy("cid").collect()] == [(1, 1, 1.5), (2, 2, None)] and "y" in child.columns
    assert files.sqlite_foreign_keys(path, "child") == [("ref", "parent", "pid")] and files.sqlite_tables(path) == ["child", "parent"]


def test_workbook(spark, tmp_path):
    path = tmp_path / "w.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>k</t></si><si><t>v</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="C2"><v>3</v></c></row></sheetData></worksheet>')
    df = files.read_workbook(spark, str(path))["S"]
    assert df.columns == ["k", "col", "v"] and [tuple(r) for r in df.collect()] == [("x", None, 3)]


MARKDOWN = """# One
| a | b |
|---|:---:|
| 1 | x |
| 2 | y |
| 3 |

| only | one |
|---|---|
| 1 | 2 |

# Two
name: n1
size: 1

name: n2
size: 2

name: n3
size: 3
"""


def test_markdown(spark, tmp_path):
    assert files.pipe_tables(MARKDOWN) == [(["a", "b"], [["1", "x"], ["2", "y"]])]
    triples, records = files.key_blocks(MARKDOWN)
    assert triples[1][0] == ["Two", "name", "n1"] and records == (["name", "size"], [["n1", "1"], ["n2", "2"], ["n3", "3"]])
    (tmp_path / "m.md").write_text(MARKDOWN)
    units = environment.load(spark, environment.EnvironmentSpec("m", str(tmp_path / "m.md")))
    assert len(units) == 3 and {u.format for u in units.values()} == {"md_struct"}


def test_environment_guards(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nA,2\n")
    units = environment.load(spark, environment.EnvironmentSpec("e", str(tmp_path / "a.csv")))
    with pytest.raises(ValueError):
        environment.save_scratch(units, str(tmp_path), [str(tmp_path / "a.csv")])
    environment.save_scratch(units, str(tmp_path / "scratch"), [str(tmp_path / "a.csv")])
    environment.save_scratch(units, str(tmp_path / "scratch"), [str(tmp_path / "a.csv")])
    with pytest.raises(PermissionError):
        environment.read_file("../x", str(tmp_path / "scratch"))


def test_mix():
    entries = [{"source_group": g, "data_file": f"{g}{i}"} for g in "ab" for i in range(10)]
    chosen = environment.choose_sources(entries, environment.parse_mix("a=3,b=1"), 8, 1)
    assert sum(e["source_group"] == "a" for e in chosen) == 6 and chosen == environment.choose_sources(entries, {"a": 3, "b": 1}, 8, 1)
