"""Workbooks and Markdown: read by tasks, held against hand-made truth."""

import tracemalloc
import zipfile

from pyspark.sql import functions as F

from tessera.sources import environment, files, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_workbook(path, sheets, shared=()):
    """A workbook of sheets given as XML of their rows."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        named = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f"<workbook {NS} {RS}><sheets>{named}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")


def test_sheets_of_every_shape(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    row = lambda *cells: "<row>" + "".join(f'<c r="{r}"{k}><v>{v}</v></c>' for r, k, v in cells) + "</row>"
    text = ' t="s"'
    write_workbook(
        path,
        {
            "One": "<row/>" + row(("A1", text, 0), ("B1", text, 0), ("D1", text, 1)) + row(("B2", "", "7"), ("D2", "", "1.5")) + "<row><c/></row>" + row(("A3", text, 2), ("B3", "", "8"), ("F3", "", "9")),
            "Header alone": row(("A1", text, 0)),
            "Empty": "",
            "Wide": row(("AA1", text, 1)) + row(("AA2", text, 2)),
        },
        ["kéy", "v", "日本 x"],
    )
    found = files.read_workbook(spark, path)
    assert list(found) == ["One", "Wide"]
    assert found["One"].dtypes == [("k_y", "string"), ("k_y_1", "bigint"), ("col", "string"), ("v", "double")]
    assert [tuple(r) for r in found["One"].collect()] == [(None, 7, None, 1.5), ("日本 x", 8, None, None)]
    assert len(found["Wide"].columns) == 27 and found["Wide"].first()[26] == "日本 x"


def test_long_sheet_in_bounded_memory(spark, tmp_path):
    """Rows are streamed: twice the rows take no more memory; all of them arrive."""
    peaks = []
    for n in (20_000, 40_000):
        path = str(tmp_path / f"{n}.xlsx")
        write_workbook(path, {"S": "<row><c><v>id</v></c><c><v>square</v></c></row>" + "".join(f"<row><c><v>{i}</v></c><c><v>{i * i}</v></c></row>" for i in range(n))})
        tracemalloc.start()
        assert sum(1 for _ in workbook.sheet_rows(path, workbook.sheets(path)["S"])) == n + 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 5_000_000
    df = files.read_workbook(spark, path)["S"]
    assert df.dtypes == [("id", "bigint"), ("square", "bigint")]
    assert tuple(df.agg(F.count("*"), F.sum("id"), F.bool_and(F.col("id") * F.col("id") == F.col("square"))).first()) == (40_000, 40_000 * 39_999 // 2, True)


def test_blocks_of_many_files(spark, tmp_path):
    names = [f"part {i}%é.md" for i in range(3)]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f"| id | v |\n|---|---|\n| {i} | x |\n|  |  |\n| {i + 10} | 2 |\n\n" + ("a: 1\nb: 2.5\n\na: 3\nb: 4\n\na: 5\nb: z\n" if i else ""))
    (tmp_path / "none.md").write_text("no table here\n")
    found = files.read_markdown(spark, *(str(tmp_path / n) for n in [*names, "none.md"]))
    assert [list(found[str(tmp_path / n)]) for n in [*names, "none.md"]] == [["0"], ["0", "1", "2"], ["0", "1", "2"], []]
    first = found[str(tmp_path / names[1])]
    assert first["0"].dtypes == [("id", "bigint"), ("v", "string")] and sorted(tuple(r) for r in first["0"].collect()) == [(1, "x"), (11, "2")]
    assert first["1"].dtypes == [("section", "string"), ("key", "string"), ("value", "string")] and first["1"].count() == 6
    assert first["2"].dtypes == [("a", "bigint"), ("b", "string")] and sorted(r["a"] for r in first["2"].collect()) == [1, 3, 5]
    units = environment.load(spark, environment.EnvironmentSpec("m", str(tmp_path / names[0])))
    assert len(units) == 7 and {u.format for u in units.values()} == {"md_struct"}


def test_blocks_of_no_texts(spark):
    texts = spark.createDataFrame([("a", None, 1), ("b", "", 2), (None, "| h |\n|---|\n| 1 |\n| 2 |\n", 3)], "path string, text string, cells int")
    found = files.markdown_blocks(texts)
    assert list(found) == [(None, 0)] and sorted(tuple(r) for r in found[None, 0].collect()) == [(1,), (2,)]
    assert files.markdown_blocks(texts.limit(0)) == {}
