"""Relational operators on small fixtures and on the driver's tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import admission, certify, graph, joins, probes, synopsis, trajectory
from tessera.operators import profile as P
from tessera.plans import compile as plans
from tessera.plans.sqltool import Environment, to_spark_sql

DATA = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def units(spark, **tables):
    out = {}
    for name, (schema, data) in tables.items():
        out[name] = graph.Unit(name, spark.createDataFrame(data, schema), name)
    return out


@pytest.fixture(scope="module")
def four(spark):
    return {
        "seeds": spark.createDataFrame([("EU",), ("EU",)], "region string"),
        "orders": spark.createDataFrame([("EU",)], "region string"),
        "marketing": spark.createDataFrame([("EU", "C1"), ("NA", "C2")], "region string, campaign string"),
        "returns": spark.createDataFrame([("C1",), ("C1",), ("C2",), ("C2",), ("C2",)], "campaign string"),
    }


def test_preaggregated_joins_equal_plain_ones(spark):
    a, b = spark.read.parquet(f"{DATA}/customer.parquet"), spark.read.parquet(f"{DATA}/supplier.parquet")
    fast, plain = joins.join_probe(a, "c_nationkey", b, "s_nationkey", None), joins.join_probe_naive(a, "c_nationkey", b, "s_nationkey", None)
    assert not plans.differs(fast, plain) and fast.count()


def test_joins_of_unlike_types_meet_as_text(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([("1",), ("x",), (None,)], "k string")
    assert rows(joins.join_probe(a, "k", b, "k")) == [("1", 1)]


def test_three_tables_join_then_chain(spark, four):
    run = lambda orders: plans.join_chain(orders, "region", four["marketing"], "region", "campaign", four["returns"], "campaign")
    assert rows(run(four["orders"])) == [("C1", 2)]
    more = four["orders"].unionByName(spark.createDataFrame([("NA",)], "region string"))
    assert rows(run(more)) == [("C2", 3), ("C1", 2)]
    assert rows(run(plans.emptied(four["orders"]))) == []


def test_three_tables_chain_then_chain(four):
    probe = probes.ranking(four["seeds"], "region")
    assert rows(plans.chain_chain(probe, "region", four["marketing"], "region", "campaign", four["returns"], "campaign")) == [("C1", 2)]


def test_declared_key_makes_a_join_edge(spark):
    u = units(spark, parent=("pid long, label string", [(1, "a"), (2, "b"), (3, "c"), (4, "d")]), child=("cid long, ref long, amt long", [(10, 1, 5), (11, 2, 6), (12, 1, 7), (13, 3, 8)]))
    u["child"].declared = [("ref", "parent", "pid")]
    g = graph.build(u)
    assert [(e.src, e.src_col, e.dst, e.dst_col, e.meta[0]) for e in g.edges if e.kind == "join"] == [("child", "ref", "parent", "pid", "declared")]
    assert graph.supported_levels(g)[:2] == [1, 2]
    path = graph.sample_path(g, 2, 7)
    assert rows(graph.execute(g, path))[0] == (1, 2)
    assert graph.depends_on_all(g, path)


def test_two_table_pipeline(spark):
    u = units(spark, orders=("region string, revenue long", [("NA", 10), ("EU", 20), ("NA", 30), ("APAC", 5)]), marketing=("region string, spend long", [("NA", 7), ("EU", 9), ("EU", 4)]))
    g = graph.build(u)
    joined = [e for e in g.edges if e.kind == "join"]
    assert joined and {joined[0].src_col, joined[0].dst_col} == {"region"}
    key = admission.answer_key(graph.execute(g, graph.Path(2, [joined[0].src, joined[0].dst], [joined[0]]), None))
    assert key.count() == 2 and not admission.guessable(key).first()["guessable"]
    assert admission.stable(lambda: graph.execute(g, graph.Path(2, [joined[0].src, joined[0].dst], [joined[0]])))


def test_join_without_decoys_is_rejected(spark):
    dim = spark.createDataFrame([("US", "NA", 1), ("GB", "EU", 2)], "code string, region string, misc long")
    fact = spark.createDataFrame([("US", "NA", 10), ("GB", "EU", 20)], "code string, region string, amt long")
    assert not joins.counterfactual_join_ok(fact, "amt", dim, "misc", [], [])
    assert isinstance(joins.counterfactual_join_ok(fact, "code", dim, "code", ["region"], ["region"]), bool)


def test_names(spark):
    pairs = [("AlbumId", "albumid"), ("customerid", "CustomerID"), ("id", "id"), ("Name", "Name"), ("AlbumId", "EmployeeId")]
    df = spark.createDataFrame(pairs, "a string, b string").select(X.names_correspond(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, True, False, False, False]
    assert graph.corresponding(spark, set(pairs)) == set(pairs[:2])


def test_bridges_and_leaks(spark):
    assert graph.bridge_size_ok(["a", "b"]) and not graph.bridge_size_ok([]) and not graph.bridge_size_ok(["x"] * 20)
    assert graph.bridge_is_dates(["2024-01-02", "2024/1/2 10:00"]) and not graph.bridge_is_dates(["2024-01-02", "x"]) and not graph.bridge_is_dates([])
    cases = [("report for CHN now", "CHN", True), ("there are 42 units", "42", True), ("Compare EU and others", "EU", True), ("business growth", "US", False), ("growth of 142", "42", False)]
    got = spark.createDataFrame(cases, "t string, v string, want boolean").select(X.contains_value(F.col("t"), F.col("v")).alias("g"), "want").collect()
    assert all(r["g"] == r["want"] for r in got)


def test_profile_of_nulls_and_types(spark):
    df = spark.createDataFrame([(1, "a", 1.5, None), (2, "a", None, None), (3, "b", 2.5, None)], "id long, kind string, price double, nothing string")
    stats = {r["col"]: r for r in P.column_stats(df, "t", ["id"]).collect()}
    assert stats["price"]["null_rate"] == pytest.approx(1 / 3) and stats["price"]["variance"] == pytest.approx(0.25)
    assert stats["kind"]["top_categories"] == ["a", "b"] and stats["nothing"]["null_rate"] == 1
    assert stats["id"]["role"] == "identifier" and stats["price"]["sample_values"] == ["1.5", "2.5"]


def test_value_samples_keep_the_smallest(spark):
    df = spark.createDataFrame([(i % 7, f"v{i % 5}" if i % 3 else "", None, "é" * (i % 2)) for i in range(60)], "n long, s string, nothing string, u string").repartition(6)
    for most in (3, 200):
        got = {(r["col"], r["class"], r["value"]) for r in P.value_samples(df, "t", most).collect()}
        assert got == {("n", "num", str(i)) for i in range(7)[:most]} | {("s", "text", f"v{i}") for i in range(5)[:most]} | {("u", "text", "é")}
    assert P.value_samples(df.where("false"), "t").count() == 0


def test_scores_and_kinds(spark):
    anchors = spark.createDataFrame([("a", 2, "ranking"), ("a", 1, "temporal"), ("b", 1, "new"), ("b", 2, "new"), ("b", 0, "ranking")], "scope string, place int, category string")
    assert {(r["scope"], r["category"], r["kind"]) for r in synopsis.dominant_kind(anchors).collect()} == {("a", "temporal", "temporal"), ("b", "new", "comparison")}
    replies = spark.createDataFrame([(0, 1.5, [0.1]), (1, None, [0.5, None, 2.0]), (2, None, []), (3, None, [None])], "i int, o double, d array<double>")
    assert [r["s"] for r in replies.select("i", synopsis.judge_score(F.col("o"), F.col("d")).alias("s")).orderBy("i").collect()] == [1.0, 0.75, 0.0, 0.0]


KEY = [("EU", 1200.0), ("NA", 17.5)]


def are_correct(spark, cases):
    """Whether each (text, key rows) is correct, through one relation."""
    answers = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "answer long, text string")
    keys = spark.createDataFrame([(i, *k) for i, (_, key) in enumerate(cases) for k in key], "answer long, label string, value double")
    return [r["correct"] for r in certify.correct(answers, keys).orderBy("answer").collect()]


def test_correct(spark):
    cases = [("EU made 1,200 and NA 17.5", True), ("EU 1210, NA 17.5", True), ("EU 1200", False), ("EU 17.5, NA 1200", False), ("1200 and 17.5", False), ("", False), (None, False), ("1200: EU, 17.5 is NA's", False), ("on 1200-01-02 EU, NA 17.5", False)]
    assert are_correct(spark, [(t, KEY) for t, _ in cases]) == [ok for _, ok in cases]
    assert are_correct(spark, [("between 41.9 and x", [(None, 42.0)]), ("only apac", [("APAC", None)]), ("a.b 3", [("A.B", 3.0)]), ("axb 3", [("A.B", 3.0)])]) == [True, True, True, False]


def test_longer_labels_shadow_shorter_ones(spark):
    assert are_correct(spark, [("North West 5, West 7", [("West", 7.0), ("North West", 5.0)]), ("North West 5, 7", [("West", 7.0), ("North West", 5.0)])]) == [True, False]


def step(text, output="label|v\nEU|1200\n", tool="execute_sql"):
    return tool, text, output


def steps_frame(spark, steps):
    return spark.createDataFrame([(i, 0, *s) for i, s in enumerate(steps)], "answer long, step int, tool string, text string, output string")


def test_computed_rules(spark):
    wide = "a|b\n" + "EU|1200\n" * 152
    cases = [
        (step("SELECT region, sum(x) FROM orders GROUP BY region"), True),
        (step("SELECT 'EU', 1200 FROM orders"), False),
        (step("SELECT region, sum(x) FROM orders GROUP BY region LIMIT 1200"), True),
        (step("SELECT * FROM orders", wide), False),
        (step("SELECT * FROM orders WHERE x > 1", wide), True),
        (step("print(1200)", tool="execute_python"), False),
        (step("print(open('x.csv').read())", tool="execute_python"), True),
        (step("print(1200 # orders", tool="execute_python"), False),
        (step("SELECT region FROM reorders"), False),
        (step(None), True),
    ]
    stated = spark.createDataFrame([(i, "EU", 1200.0) for i in range(len(cases))], "answer long, label string, value double")
    found = certify.support(stated, steps_frame(spark, [s for s, _ in cases]), F.array(F.lit("orders")))
    assert {r["answer"] for r in found.collect()} == {i for i, (_, ok) in enumerate(cases) if ok}
    assert [r["computed"] for r in certify.computed(stated, found).orderBy("answer").collect()] == [ok for _, ok in cases]


def test_certificates_with_emptied_sources(spark):
    env = Environment(spark, {"orders": spark.createDataFrame([("EU", 700.0), ("EU", 500.0), ("NA", 900.0)], "region string, revenue double"), "marketing": spark.createDataFrame([("EU", 40.0)], "region string, spend double")})
    uses = "SELECT region, sum(revenue) AS v FROM orders WHERE region IN (SELECT region FROM marketing) GROUP BY region"
    idle = "SELECT o.region, sum(o.revenue) AS v FROM orders o LEFT JOIN marketing m ON m.region = 'no such' WHERE o.region = 'EU' GROUP BY o.region"
    only = "SELECT region, sum(revenue) AS v FROM orders WHERE region = 'EU' GROUP BY region"
    cases = [(uses, ["orders", "marketing"], 0.95, ""), (idle, ["orders", "marketing"], 0.5, "marketing"), (only, ["orders", "marketing"], 0.5, "marketing"), (uses, ["orders"], 0.95, "")]
    results = [env.execute_sql(query) for query, *_ in cases]
    assert all(r.success for r in results)
    answers = spark.createDataFrame([(i, "EU revenue is 1200.", "x") for i in range(4)] + [(4, "EU revenue is 1.", "x"), (5, "x", "x")], "answer long, text string, truth string")
    keys = spark.createDataFrame([(i, "EU", 1200.0) for i in range(5)], "answer long, label string, value double")
    required = spark.createDataFrame([(i, s) for i, (_, needs, *_) in enumerate(cases) for s in needs], "answer long, source string")
    steps = steps_frame(spark, [step(query, r.stdout) for (query, *_), r in zip(cases, results)])
    got = certify.certify(answers, keys, steps, F.array(F.lit("orders"), F.lit("marketing")), required, env.replay).orderBy("answer").collect()
    assert [(r["v_q"], r["covered_fail"]) for r in got] == [(score, failing) for *_, score, failing in cases] + [(0.0, ""), (1.0, "")]
    assert got[0]["lineage"][0].asDict() == {"label": "EU", "value": 1200.0, "query": uses, "output_row": "EU|1200.0"} and not got[4]["correct"]
    assert env.execute_sql("SELECT count(*) AS n FROM marketing").rows[0]["n"] == 1


def test_guard_and_shim(spark):
    env = Environment(spark, {"t": spark.range(5).toDF("id")})
    assert not env.execute_sql("DROP TABLE t").success and not env.execute_sql("SELECT 1; SELECT 2").success
    for out in ("INSERT OVERWRITE DIRECTORY '/tmp/never-written' USING parquet SELECT * FROM q", "INSERT INTO t SELECT * FROM q", "FROM q INSERT INTO t SELECT a", "SELECT * FROM q) x, (SELECT 1"):
        assert not env.execute_sql(f"WITH q AS (SELECT 1 AS a) {out}").success
    assert not os.path.exists("/tmp/never-written")
    for out in ("SELECT count(*) FROM parquet.`/root/testdata/sf0.001/region.parquet`", "SELECT * FROM text.`/etc/passwd`", "SELECT reflect('java.lang.System', 'getenv', 'HOME')"):
        assert not env.execute_sql(out).success
    assert env.execute_sql("WITH q AS (SELECT id FROM t) SELECT count(*) AS n FROM q -- with a comment").stdout == "n\n5"
    assert env.execute_sql("SELECT CAST(id / 2 AS TEXT) AS a, CAST((CAST('3x' AS INTEGER)) AS REAL) AS b, CAST(NULL AS REAL) AS c FROM t WHERE id = 3").stdout == "a|b|c\n1|3.0|"
    assert env.execute_sql("SELECT group_concat(DISTINCT id % 1) AS g, total((id)) AS t, avg(id) AS m FROM t").stdout == "g|t|m\n0|10.0|2.0"
    assert env.execute_sql("PRAGMA table_info(t)").success and "t" in env.execute_sql(".tables").stdout
    assert env.execute_sql("SELECT id FROM t ORDER BY id LIMIT 2, 2").stdout == "id\n2\n3"
    assert to_spark_sql("SELECT 'a LIKE b; \"x\"' FROM \"t\" WHERE 0") == "SELECT 'a LIKE b; \"x\"' FROM `t` WHERE false"
    assert env.list_tables().stdout == "t" and env.table_schema("t").stdout == "0|id|BIGINT|1"


def test_margin_and_keys(spark):
    df = lambda *v: spark.createDataFrame([(f"k{i}", float(x)) for i, x in enumerate(v)], "label string, n double")
    margin = lambda *v: admission.rank_margin(df(*v), "n", [F.desc("n"), F.col("label")], 2).first()["margin_ok"]
    assert not margin(100, 90, 90) and margin(100, 90, 50) and margin(100)
    assert admission.answer_key(df(1, 2).withColumn("x", F.lit(1))) is None
    assert admission.answer_key(df(1, 2), cap=2) is None
    guess = lambda data: admission.guessable(spark.createDataFrame(data, admission.KEY_SCHEMA)).first()["guessable"]
    assert guess([("a", 1.0, "1"), ("b", 0.0, "0")]) and guess([("Yes", None, "Yes")]) and guess([]) and not guess([("a", 1200.0, "")]) and not guess([("a", 1.0, ""), ("b", 900.0, "")])


def test_masking_hides_data(spark):
    out = spark.createDataFrame([("SELECT a FROM t WHERE b = 'SECRET''s' AND c IN (1, 2) LIMIT 17",)], "q string").select(X.mask_literals(F.col("q")).alias("m")).first()["m"]
    assert "SECRET" not in out and not re.search(r"\d", out)


def test_levels_and_repeats(spark):
    got = spark.createDataFrame([("1",), ("2",), ("3",), (None,), ("4",), ("weird",), ("M2",)], "x string").select(trajectory.level(F.col("x")).alias("l")).collect()
    assert [r["l"] for r in got] == [1, 2, 3, 1, 1, 1, 2]
    steps = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "a", "b", "a"])] + [(2, 0, "a"), (2, 1, "a")], "t long, i int, x string")
    assert sorted(rows(trajectory.drop_repeats(steps, "t", "i", [F.col("x")]).select("t", "i"))) == [(1, 0), (1, 2), (2, 0), (2, 1)]


def test_question_paths(spark):
    u = units(spark, orders=("region string, revenue long", [("NA", 10), ("EU", 20), ("NA", 30), ("APAC", 5)]), marketing=("region string, spend long", [("NA", 7), ("EU", 9), ("EU", 4)]))
    g = graph.Graph(u, [graph.Edge("orders", "marketing", "join", "region", "region")])
    assert graph.paths_for_question(g, "revenue and spend of each region")[0].level == 2
    assert graph.paths_for_question(g, "weather") == []
    assert "joined with" in graph.describe(g, graph.paths(g, 2)[0])
