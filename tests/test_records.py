"""Anchor and contract records, key rows of every shape, mended JSON, profiles within a time."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import lenient
from tessera.operators import profile as P
from tessera.operators import provenance


def test_a_record_keeps_the_first_of_a_result(spark):
    rows = [(f"Label {i // 2}".upper() if i % 2 else f"Label {i // 2}", "1,200" if i == 0 else "x" * 41, None if i == 3 else 100 - i) for i in range(30)]
    r = provenance.record(spark.createDataFrame(rows, "a string, b string, n int").repartition(3), [F.desc_nulls_last("n")], "SELECT 1", ["u", "v"], "ranking", "clause").first()
    assert (r["n_rows"], r["units"], len(r["rows"]), r["anchor"][:2]) == (30, ["u", "v"], 12, "a_")
    assert r["rows"][0].asDict(True) == {"labels": ["Label 0"], "nums": [1200.0, 100.0]} and r["labels"] == [f"Label {i}" if i != 1 else "Label 1" for i in range(7)][: len(r["labels"])]
    assert len(r["nums"]) == 12 and len(r["signature"]) == 12
    assert provenance.record(spark.createDataFrame([], "a string, n int"), [F.asc("n")], "q", ["u"], "ranking").count() == 0


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    c = provenance.contract(df, "q", ["u", "u", "v"], " clause ").first()
    assert (c["clause"], c["units"], c["n_rows"], [tuple(x) for x in c["key_rows"]]) == ("clause", ["u", "v"], 2, [("a", 1.0), ("b", 2.0)])
    assert provenance.contract(df, "q", ["u"], "  ") is None


def test_key_rows_of_every_shape(spark):
    rows = [
        (1, "a", 2.0, None, [(["z"], [9.0])], ["y"], [8.0]), (1, "a", 2.0, None, None, None, None), (1, "", None, "raw", None, None, None), (1, "b", None, "raw", None, None, None),
        (2, "a", None, None, [(["r", "s"], [3.0, 4.0]), ([], [5.0]), (["t"], None), (None, None), ([""], [])], ["y"], None),
        (3, None, None, None, [], ["l", "m"], [6.0, 7.0]), (4, None, None, None, None, None, [6.0, 7.0, 6.0]), (5, None, None, None, None, ["l", "", "m"], []), (6, None, None, None, None, None, None),
    ]
    got = provenance.key_rows(spark.createDataFrame(rows, "k int, label string, value double, raw string, rows array<struct<labels:array<string>,nums:array<double>>>, labels array<string>, nums array<double>"), ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 2.0), (1, "b", None), (2, "r", 3.0), (2, None, 5.0), (2, "t", None), (3, "l", 6.0), (4, None, 6.0), (4, None, 7.0), (5, "l", None), (5, "m", None)], key=str)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('x {"a": 1} {"a": 2}', {"a": 1}), ('{"b": 1} {"a": 2}', {"a": 2}), ('{"a": [1, 2,], "t": True, "n": None,}', {"a": [1, 2], "t": True, "n": None}), ('{"a": "un\nbroken", // note\n "b": "http://x"}', {"a": "un\nbroken", "b": "http://x"}),
        ('{"a": {"b": [1, {"c": "d', {"a": {"b": [1, {"c": "d"}]}}), ('<think>{"a": 0}</think>{"a": "True, }"}', {"a": "True, }"}), ("{a: 1}", None), ("", None), (None, None), ('{{"a": 3}}', {"a": 3}), ('{"a": "\\"}"}', {"a": '"}'}),
    ],
)
def test_objects_among_other_things(text, found):
    assert lenient.first_object(text, "a") == found


def test_objects_of_a_column(spark):
    df = spark.createDataFrame([(1, 'say {"a": "é",}'), (2, None), (3, "none")], "k int, t string")
    assert [r["j"] for r in df.orderBy("k").select(lenient.json_object(F.col("t")).alias("j")).collect()] == ['{"a": "é"}', None, None]


def test_profiles_within_a_time(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    rows, late = P.stats_within({"one": (df, ["k"]), "two": (df, ["k"])}, 300)
    assert {r["unit_id"] for r in rows} == {"one", "two"} and len(rows) == 4 and not late
    assert P.stats_within({"one": (df, ["k"])}, 0) == ([], ["one"])
