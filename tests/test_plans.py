"""The shapes of the plans: what is read, pushed down and broadcast, and what is never done."""

import pytest
from pyspark.sql import functions as F

from tessera import queries as core
from tessera.operators import joins, probes
from tessera.plans import compile as plans

DATA = "/root/testdata/sf0.001"


def shape(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_a_probe_needs(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    text = shape(probes.ranking(orders, "o_orderstatus"))
    assert "ReadSchema: struct<o_orderstatus:string>" in text and "IsNotNull(o_orderstatus)" in text
    assert "TakeOrderedAndProject" in text and "Python" not in text


def test_join_probes_count_before_they_join(spark):
    a, b = spark.read.parquet(f"{DATA}/orders.parquet"), spark.read.parquet(f"{DATA}/customer.parquet")
    text = shape(joins.join_probe(a, "o_custkey", b, "c_custkey"))
    assert text.index("Join") < text.index("HashAggregate")
    assert "ReadSchema: struct<o_custkey:bigint>" in text and "ReadSchema: struct<c_custkey:bigint>" in text


def test_chains_are_broadcast_semi_joins(spark):
    a, b = spark.read.parquet(f"{DATA}/customer.parquet"), spark.read.parquet(f"{DATA}/supplier.parquet")
    text = shape(plans.chain(probes.ranking(a, "c_nationkey"), "c_nationkey", b, "s_nationkey"))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text


def test_emptied_sources_are_folded_away(spark):
    a = spark.read.parquet(f"{DATA}/customer.parquet")
    assert "FileScan" not in shape(plans.emptied(a).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")))


@pytest.mark.parametrize("name", ["tolerance_support", "label_clause_assign", "error_runs", "trajectory_rank", "export_messages", "steps_dedupe", "level3_join_chain", "sql_in_subquery", "ext_session"])
def test_no_products_and_no_python(spark, name):
    text = shape(core.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text


def test_streams_equal_batches(spark, tmp_path):
    from tessera.streaming.progress import windowed_counts

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "1 hour")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    try:
        query.processAllAvailable()
        assert not plans.differs(spark.table("windows"), windowed_counts(events, "ts", "event_type", "1 hour"))
    finally:
        query.stop()


def test_running_failures(spark, tmp_path):
    from tessera.streaming.progress import running_failures

    rows = spark.createDataFrame([("r", i % 4 == 0) for i in range(12)] + [("s", True)], "run_id string, success boolean")
    rows.write.parquet(str(tmp_path / "in"))
    stream = running_failures(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("failures").outputMode("update").start()
    try:
        query.processAllAvailable()
        last = {r["run_id"]: (r["n"], r["failed"], r["abort"]) for r in spark.table("failures").collect()}
        assert last == {"r": (12, 9, True), "s": (1, 0, False)}
    finally:
        query.stop()
