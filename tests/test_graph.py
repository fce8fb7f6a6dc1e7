"""Edges from one table of counts, and their log, against probes run one at a time."""

import random
import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import graph, joins
from tessera.session import within

DATA = "/root/testdata/sf0.001"


def frames(spark):
    draw = random.Random(4)
    pick = lambda n: [draw.choice(["a", "b", "c", "dd", "1", "2", "", None, "x" * 300]) for _ in range(n)]
    left = list(zip(pick(80), [draw.choice([1, 2, 3, None]) for _ in range(80)], [float(draw.randrange(4)) for _ in range(80)]))
    right = list(zip(pick(50), [draw.choice([2, 3, 9]) for _ in range(50)]))
    return spark.createDataFrame(left, "t string, k long, `odd.name` double").repartition(3), spark.createDataFrame(right, "t string, k int")


def test_pair_facts_equal_probes_one_by_one(spark):
    a, b = frames(spark)
    pairs = [("t-t", "a", "t", "b", "t"), ("k-k", "a", "k", "b", "k"), ("t-k", "a", "t", "b", "k"), ("none", "a", "odd.name", "b", "t")]
    counts = joins.value_counts({"a": (a, ["t", "k", "odd.name"]), "b": (b, ["t", "k"])})
    got = {r["pair"]: (r["n_keys"], r["pairs"], r["side_src"], r["side_dst"]) for r in joins.pair_facts(counts, spark.createDataFrame(pairs, "pair string, unit_a string, col_a string, unit_b string, col_b string")).collect()}
    for pair, _, ca, _, cb in pairs[:3]:
        f = joins.fanout(a, ca, b, cb).first()
        assert got[pair] == (joins.key_counts(a, ca, b, cb).count(), f["fanout_src"], f["side_src"], f["side_dst"])
    assert got["none"][0] == 2  # 1 and 2, the doubles without their fraction


def test_probes_are_one_shuffle_of_counts(spark):
    """However many pairs are probed, the tables are read and counted once."""
    a, b = frames(spark)
    pairs = spark.createDataFrame([(str(i), "a", x, "b", y) for i in range(30) for x in ("t", "k") for y in ("t", "k")], "pair string, unit_a string, col_a string, unit_b string, col_b string")
    text = joins.pair_facts(joins.value_counts({"a": (a, ["t", "k"]), "b": (b, ["t", "k"])}), pairs)._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") == 3 and "CartesianProduct" not in text and text.count("Generate explode") == 3


@pytest.fixture(scope="module")
def built(spark):
    regions = ["EU", "NA", "ASIA", "LATAM", "AFRICA"]
    orders = spark.createDataFrame([(i, regions[i % 3], float(i)) for i in range(60)], "order_id long, region string, amount double")
    sites = spark.createDataFrame([(100 + i, regions[i % 5], "x") for i in range(40)], "site_id long, area string, note string")
    numbers = spark.createDataFrame([(i % 4, i) for i in range(30)], "grade long, v long")
    units = {n: graph.Unit(n, df, n, order=tuple(df.columns[:1])) for n, df in (("orders", orders), ("sites", sites), ("numbers", numbers))}
    return graph.build(units)


def test_chains_are_admitted_by_what_they_select(built):
    chains = {(r["src"], r["dst"]): (r["decision"], r["n_keys"], r["n_decoys"]) for r in built.log if r["kind"] == "chain" and r["decision"] != "chain_second"}
    assert chains[("orders", "sites")] == ("chain_admitted", 3, 2)
    assert chains[("sites", "orders")] == ("chain_counterfactual", 3, 0)
    edge = next(e for e in built.edges if e.kind == "chain")
    assert (edge.src, edge.src_col, edge.dst, edge.dst_col) == ("orders", "region", "sites", "area") and set(edge.meta[1]) == {"EU", "NA", "ASIA"}
    assert graph.execute(built, graph.Path(2, [edge.src, edge.dst], [edge])).count() == 3


def test_the_log_adds_up(spark, built):
    log = spark.createDataFrame([graph.Row(**r) for r in built.log], graph.LOG)
    n = {r["name"]: r["n"] for r in graph.counters(log).collect()}
    assert n["join_verified"] == n["join_kept"] + n["join_trivial"] + n["join_fanout"] + n["join_counterfactual"] == built.counts["join_proposed"]
    assert n["chain_verified"] == n["chain_kept"] + n["chain_trivial"] + n["chain_counterfactual"] and n["chain_kept"] == 1


@pytest.fixture(scope="module")
def hot(spark):
    """Two tables whose shared values have 60,000 rows on either side, so a square of joined rows passes 64 bits."""
    rows = spark.range(120_000).select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("flag"))
    return graph.build({"left": graph.Unit("left", rows, "left", order=("id",)), "right": graph.Unit("right", rows.select("flag"), "right", order=("flag",))})


def test_hot_keys_are_counted(spark, hot):
    n = {r["name"]: r["n"] for r in graph.counters(spark.createDataFrame([graph.Row(**r) for r in hot.log], graph.LOG)).collect()}
    assert n["join_verified"] == n["join_fanout"] == 1 and n["join_kept"] == 0


def test_hot_keys_are_decided(spark, hot):
    (join,) = [r for r in hot.log if r["kind"] == "join"]
    assert (join["decision"], join["n_keys"], join["pairs"]) == ("join_fanout", 2, 60_000**2)
    most = 2**63 - 1
    sides = spark.createDataFrame([(most, most, True), (8, 8, False), (13, 5, True), (1, most, False), (0, 0, False), (2, 2, False)], "x long, y long, want boolean")
    assert all(r["want"] == r["got"] == (not joins.fanout_ok(r["x"], r["y"], 0, 0, False)) for r in sides.withColumn("got", joins.fans_out(F.col("x"), F.col("y"))).collect())


def test_roles_of_a_bridge(spark):
    rows = [("identifier", "identifier", True, True, True), ("identifier", "identifier", True, False, False), ("entity", "category", False, False, True), ("entity", "category", True, True, False), ("category", "identifier", False, False, False), ("time", "time", False, False, True), ("entity", "measure", False, True, False)]
    df = spark.createDataFrame(rows, "a string, b string, numeric boolean, named boolean, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", graph.role_fits(F.col("a"), F.col("b"), F.col("numeric"), F.col("named"))).collect())


def test_jobs_end_with_their_time(spark):
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    began = time.monotonic()
    assert within(spark, 1.0, lambda: spark.range(4).select(slow("id")).collect()) is None
    assert time.monotonic() - began < 15 and within(spark, 60, lambda: spark.range(4).count()) == 4
    with pytest.raises(ZeroDivisionError):
        within(spark, 60, lambda: 1 // 0)


def test_a_failure_beyond_the_time_is_raised(spark):
    """Only the cancellation by the time itself is None; all of these fail when it is over."""
    late = lambda action: within(spark, 0.1, lambda: time.sleep(1) or action())
    with pytest.raises(ZeroDivisionError):
        late(lambda: 1 // 0)
    with pytest.raises(Exception, match="its own fault"):
        late(spark.range(1).select(F.raise_error(F.lit("its own fault"))).collect)
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    context = spark.sparkContext
    context.addJobTag("another")
    threading.Timer(4.0, context.cancelJobsWithTag, ("another",)).start()
    try:
        with pytest.raises(Exception, match="cancelled part of cancelled job tags another"):
            late(spark.range(4).select(slow("id")).collect)
    finally:
        context.removeJobTag("another")


def test_stages_that_end_with_their_time_are_late(spark):
    """Stages that run side by side and are cancelled together are no failure of their own."""
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    side = lambda: spark.range(2, numPartitions=1).select(slow("id").alias("id")).groupBy("id").count()
    assert within(spark, 6.0, side().join(side().hint("merge"), "id").collect) is None


def test_a_graph_out_of_time_is_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(40)], "id long, flag string")
    units = lambda: {n: graph.Unit(n, df, n, order=tuple(df.columns[:1])) for n, df in (("left", rows), ("right", rows.select("flag")))}
    with pytest.raises(TimeoutError):
        graph.build(units(), seconds=0)
    monkeypatch.setattr(graph, "within", lambda *_: None)  # its jobs were cancelled
    with pytest.raises(TimeoutError):
        graph.build(units(), seconds=3600)
    assert graph.build(units()).log


@pytest.mark.parametrize("name", ["graph_counters", "graph_decisions"])
def test_graph_queries_have_no_time_to_run_out_of(spark, monkeypatch, name):
    """Where whatever has a time runs out of it, the rows are still those of the SQL."""
    monkeypatch.setattr(graph, "within", lambda *_: None)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM '{DATA}/lineitem.parquet'")
    df, found = queries.queries()[name](spark, DATA), db.sql(queries.oracle_sql()[name])
    assert df.columns == found.columns and sorted(map(tuple, df.collect())) == sorted(found.fetchall())
