"""Places in a total order, and ways up a tree, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable


def _ranged(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """df dealt by ranges of the order, with its part's number, and each part's rows and the rows before it."""
    parts = durable(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts, sizes.withColumn("_before", before)  # one row a part


def places(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in an order that must be total: a row's place in its range, after all rows of the ranges before."""
    parts, sizes = _ranged(df, order)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_size", "_before")


def first_share(df: DataFrame, order: Sequence[Column], share: int) -> DataFrame:
    """The first of `share` equal parts of df in a total order, as ntile has it: the rows of whole ranges as they are, and of the range that the cut falls in the first ones."""
    parts, sizes = _ranged(df, order)
    whole = F.sum("_size").over(Window.partitionBy())
    cut = sizes.withColumn("_cut", F.ceil(whole / F.lit(share)).cast("long") - F.col("_before")).where("_cut > 0")
    met = parts.join(F.broadcast(cut), "_part")
    inside = met.where("_size <= _cut")
    edge = met.where("_size > _cut").withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).where("_own <= _cut").drop("_own")
    return inside.unionByName(edge).drop("_part", "_size", "_before", "_cut")


def ways_up(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf, node_id, hops: every node on the way from each leaf (node_id) to its root, of nodes (node_id, parent_id).

    Pointer doubling: after round k the ways hold all nodes up to 2**k hops away, and each node
    knows the one 2**k above it; so rounds go by the logarithm of the depth. Leaves that are no
    nodes have no way; a parent that is no node ends it. A cycle is an error.
    """
    known = nodes.select("node_id")
    up = durable(nodes.where("parent_id is not null").select("node_id", F.col("parent_id").alias("up")).join(known.select(F.col("node_id").alias("up")), "up").select("node_id", "up"))
    ways = durable(leaves.select("node_id").join(known, "node_id").select(F.col("node_id").alias("leaf"), "node_id", F.lit(0).alias("hops")))
    most, step = nodes.count(), 1
    while not up.isEmpty():
        if step > most:
            raise ValueError("the parents go round in a circle")
        farther = ways.join(up, "node_id").select("leaf", F.col("up").alias("node_id"), (F.col("hops") + step).alias("hops"))
        ways = durable(ways.unionByName(farther))
        above = up.select(F.col("node_id").alias("up"), F.col("up").alias("above"))
        up = durable(up.join(above, "up").select("node_id", F.col("above").alias("up")))
        step *= 2
    return ways
