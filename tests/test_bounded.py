"""Operators that replace all pairs, whole shuffles and single tasks, against the plain forms."""

import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import admission, bands, certify, labels, order, trajectory
from tessera.operators import profile as P
from tessera.plans import statements


def shape(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Bands


def test_near_equals_the_theta_join(spark):
    draw = random.Random(1)
    edge = [0.0, -0.0, 1e-10, -1e-10, 9e-7, -9e-7, 1.1e-6, 1e-9, 100.0, 99.0, 101.0, -100.0, -99.0, 98.99999, 1e300, 1.005e300, -5e-324, math.inf, -math.inf, math.nan]
    values = [(k, v) for k in (1, 2) for v in edge + [draw.choice([-1, 1]) * 10 ** draw.uniform(-9, 9) for _ in range(40)]] + [(1, None), (3, 5.0)]
    facts = [(k, v * (1 + draw.uniform(-0.012, 0.012))) for k, v in values if v is not None] + [(k, v) for k in (1, 2) for v in edge] + [(2, None)]
    a, b = spark.createDataFrame(values, "k int, value double"), spark.createDataFrame(facts, "k int, num double")
    got = Counter(map(repr, bands.near(a, b, ["k"]).select("k", "value", "num").collect()))
    sane = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    want = Counter(map(repr, a.where(sane("value")).join(b.where(sane("num")), "k").where(X.close(F.col("num"), F.col("value"))).select("k", "value", "num").collect()))
    assert got == want and sum(got.values()) > 150


def test_an_answer_of_many_numbers(spark):
    """A hundred thousand values meet a hundred thousand numbers by cells, not by each other."""
    n = 100_000
    stated = spark.range(n).select(F.lit(7).alias("task"), F.pow(F.lit(1.03), F.col("id") % 2000).alias("value"), "id").select("task", (F.col("value") * (1 + (F.col("id") % 7) * 1e-5)).alias("value"))
    steps = spark.range(50).select(F.lit(7).alias("task"), F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda k: F.pow(F.lit(1.03), k.cast("double"))).alias("nums"), F.array(F.lit(-1.0)).alias("literals"))
    found = certify.tolerance_support(stated, steps.limit(1))
    assert found.count() == stated.distinct().count()
    assert "CartesianProduct" not in shape(found) and "NestedLoop" not in shape(found)


def test_a_typed_number_backs_nothing(spark):
    stated = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 0.0), (2, 10.0)], "task int, value double")
    steps = spark.createDataFrame([(1, [10.05, 20.1], [20.0]), (1, [1e-7], None), (2, None, [10.0]), (2, [9.95], [])], "task int, nums array<double>, literals array<double>")
    assert sorted(map(tuple, certify.tolerance_support(stated, steps).collect())) == [(1, 0.0), (1, 10.0), (2, 10.0)]


# Labels


def marks_by_hand(text, own):
    found = sorted({(m.start(), -m.end(), label) for label in own if label for m in re.finditer(re.escape(label), text)})
    out, reached = [], -1
    for start, end, label in found:
        if reached < -end:
            out.append((start, label))
        reached = max(reached, -end)
    return out


def test_label_marks_equal_one_search_a_label(spark):
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abé. ") for _ in range(draw.randrange(n)))
    answers = [(k, word(60).upper() if k % 2 else word(60)) for k in range(80)] + [(100, None), (101, ""), (102, "no labels"), (103, "a" * 5000)]
    own = [(k, word(5).lower()) for k in range(80) for _ in range(6)] + [(103, "aa"), (103, "aaa"), (103, None), (100, "a"), (104, "x")]
    got = labels.label_marks(spark.createDataFrame(answers, "answer long, text string").repartition(3), spark.createDataFrame(own, "answer long, label string"))
    want = [(k, p, label) for k, t in answers for p, label in marks_by_hand((t or "").lower(), {x for i, x in own if i == k and x})]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_leaks_equal_one_pattern_a_value(spark):
    texts = ["growth of 142 in us", "42", "x.42", "42.", "4 42a", "a_42 -42", "-42", "U S", "us-east", "Straße straßen", "a b", "", None, "it is 3.5x or 3.50 or 13.5", "İs", "cafés café"]
    hidden = ["42", "us", "q", " ", "", "3.5", "straße", "-7", "café", "EU (total)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = F.lit(False)
    for value in hidden:
        want = want | X.contains_value(F.col("t"), F.lit(value))
    rows = admission.leaks(df.withColumn("want", want), "t", hidden).collect()
    assert [(r["i"], r["leaks"]) for r in rows] == [(r["i"], r["want"]) for r in rows]
    assert not admission.leaks(df, "t", []).where("leaks").count()
    many = admission.leaks(df, "t", [f"value {i}" for i in range(5000)] + ["142"])
    assert [r["i"] for r in many.where("leaks").collect()] == [0] and len(shape(many)) < 3000


# Top categories


@pytest.mark.parametrize(("counters", "survivors"), [(512, 1024), (4, 1024), (4, 3), (1, 2)])
def test_top_categories_equal_full_counts(spark, monkeypatch, counters, survivors):
    monkeypatch.setattr(P, "COUNTERS", counters)
    monkeypatch.setattr(P, "SURVIVORS", survivors)
    draw = random.Random(counters)
    skewed = lambda: draw.choice(["a"] * 30 + ["b"] * 20 + ["c"] * 12 + list("defghij"))
    rows = [(skewed(), f"u{i}", draw.choice(["x", None]), None, draw.choice(list("pqrstuvw")), i) for i in range(400)]
    df = spark.createDataFrame(rows, "skewed string, unlike string, one string, none string, even string, n int").repartition(5)
    got = sorted((r["col"], r["value"], r["n"], r["rank"]) for r in P.top_categories(df, 3).collect())
    want = []
    for k, col in enumerate(("skewed", "unlike", "one", "none", "even")):
        ranked = sorted(Counter(r[k] for r in rows if r[k] is not None).items(), key=lambda x: (-x[1], x[0]))[:3]
        want += [(col, v, n, i + 1) for i, (v, n) in enumerate(ranked)]
    assert got == sorted(want)


def test_skewed_columns_are_decided_by_summaries(spark, monkeypatch):
    monkeypatch.setattr(P, "COUNTERS", 8)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 5 == 0, F.lit("warm")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("c0"), F.col("id").cast("string").alias("c1"))
    kept, undecided = P.frequent(df.repartition(4), 2)
    assert {(r["ordinal"], r["value"]) for r in kept.collect()} == {(0, "hot"), (0, "warm")} and [r["ordinal"] for r in undecided.collect()] == [1]


# Orders and trees


def test_places_and_shares_equal_one_window(spark):
    draw = random.Random(5)
    values = [draw.randrange(20) for _ in range(503)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    want = {i: p + 1 for p, (v, i) in enumerate(sorted(((-v, i) for i, v in enumerate(values))))}
    by = [F.desc("v"), F.asc("id")]
    assert {r["id"]: r["place"] for r in order.places(df, by).collect()} == want
    for share in (1, 4, 7, 600):
        size = 503 // share + (503 % share > 0)
        assert {r["id"] for r in order.first_share(df, by, share).collect()} == {i for i, p in want.items() if p <= size}
    assert order.first_share(df.where("false"), by, 4).count() == 0 and order.places(df.where("false"), by).count() == 0


def test_eviction_has_no_window_over_all_rows(spark):
    nodes = spark.range(1000).select(F.col("id").alias("node_id"), (F.col("id") % 13).alias("age"), (F.col("id") % 7 / 7.0).alias("avg_reward"), (F.col("id") % 3 > 0).alias("is_leaf"))
    worst = trajectory.evict(nodes)
    text = shape(worst)
    assert text.count("Window [row_number()") <= 1 and "partitionBy" not in text and "_part" in text
    want = sorted(nodes.where("is_leaf").collect(), key=lambda r: (-(r["age"] - 100 * r["avg_reward"]), r["node_id"]))
    assert {r["node_id"] for r in worst.collect()} == {r["node_id"] for r in want[: -(-len(want) // 4)]}


def test_ways_of_any_length(spark):
    deep = spark.range(10_000).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    found = trajectory.parents(deep, spark.createDataFrame([(9_999,), (3,), (77_777,)], "node_id long"))
    assert found.where("leaf = 9999").count() == 10_000 and found.where("leaf = 9999").agg(F.sum(F.abs(9999 - F.col("hops") - F.col("node_id")))).first()[0] == 0
    assert sorted(map(tuple, found.where("leaf <> 9999").collect())) == [(3, 3 - h, h) for h in (3, 2, 1, 0)]
    odd = spark.createDataFrame([(1, 2), (2, None), (3, 99), (4, 4)], "node_id long, parent_id long")
    assert sorted(map(tuple, trajectory.parents(odd.where("node_id < 4"), odd.select("node_id")).collect())) == [(1, 1, 0), (1, 2, 1), (2, 2, 0), (3, 3, 0)]
    with pytest.raises(ValueError, match="circle"):
        trajectory.parents(odd, odd.select("node_id"))


# Replays


def test_each_statement_is_replayed_once(spark):
    """Two hundred answers with three statements and two sources: three runs, and one for each statement and source emptied."""
    rows = [(k, s, k % 5, "execute_sql", f"SELECT {k % 3} FROM t") for k in range(200) for s in ("t", "u")] + [(900, "t", 0, "execute_python", "print(1)")]
    needed = spark.createDataFrame(rows, "answer long, source string, step int, tool string, text string")
    runs = []
    got = certify.replayed(needed, lambda text, gone: runs.append((text, gone)) or (None if gone == "u" and " 2 " in text else f"{text}/{gone == 't'}")).collect()
    assert len(got) == 400 and sorted(runs, key=repr) == sorted({(f"SELECT {k} FROM t", g) for k in range(3) for g in (None, "t", "u")}, key=repr)
    assert all(r["after"] == (None if r["source"] == "u" and r["answer"] % 3 == 2 else f"SELECT {r['answer'] % 3} FROM t/{r['source'] == 't'}") for r in got)


def test_each_step_is_read_once(spark, monkeypatch):
    """However many parts of a certificate rest on what is told of a step, its statement is read once."""
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf(statements._FACTS)
    def counted(text: pd.Series) -> pd.DataFrame:
        read.add(len(text))
        return statements.statement_facts.func(text)

    monkeypatch.setattr(certify, "statement_facts", counted)
    answers = spark.createDataFrame([(k, f"EU holds {k + 1000}", "x") for k in range(40)], "answer long, text string, truth string")
    keys = answers.select("answer", F.lit("EU").alias("label"), (F.col("answer") + 1000.0).alias("value"))
    steps = answers.select("answer", F.lit(0).alias("step"), F.lit("execute_sql").alias("tool"), F.lit("SELECT sum(x) FROM t").alias("text"), F.concat(F.lit("label|n\nA|"), F.col("answer") + 1000).alias("output"))
    required = answers.select("answer", F.lit("t").alias("source"))
    got = certify.certify(answers, keys, steps, F.array(F.lit("t")), required, lambda text, gone: str(gone)).collect()
    assert read.value == 40 and len(got) == 40 and all((r["v_q"], r["covered"], r["replays"]) == (0.95, True, 1) for r in got)


def test_digests_tell_results_apart(spark):
    from tessera.plans.sqltool import Environment, digest

    a = spark.createDataFrame([(1, "x", 0.1), (1, "x", 0.1), (None, "y", 2.0)], "k int, t string, v double")
    same = [a, a.repartition(3), a.orderBy("t"), a.withColumn("v", F.col("v") + 1e-14), a.toDF("k", "u", "w")]
    other = [a.distinct(), a.withColumn("k", F.col("k").cast("string")), a.where("k = 1"), a.fillna(0), a.where("false"), a.select("t", "v")]
    assert len({digest(x) for x in same}) == 1 and not {digest(x) for x in other} & {digest(a)}
    env = Environment(spark, {"a": a, "b": a})
    whole = env.replay("SELECT count(*) FROM a, b", None)
    assert whole != env.replay("SELECT count(*) FROM a, b", "b") == env.replay("SELECT count(*) FROM a, b", "a") and env.replay("DROP TABLE a", None) is None and len(env._emptied) == 2
