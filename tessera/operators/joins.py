"""Join discovery: containment of value samples, ranked proposals, executed and measured joins.

A probe's counts by key are joined after both sides are counted, so a key with a and b rows
costs one row a side, not a times b; the product is the join's row count for that key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import profile

DECOYS, VERIFY, FANOUT = 4, 20, 64


def containment(samples: DataFrame) -> DataFrame:
    """Column pairs of different units with shared values: unit_a, col_a, unit_b, col_b, n_shared, containment (of a in b).

    samples holds at most a few hundred values a column, so the self-join on value is bounded
    by columns times sample.
    """
    cards = samples.groupBy("unit_id", "col").agg(F.count(F.lit(1)).alias("card"))
    a = samples.select(F.col("unit_id").alias("unit_a"), F.col("col").alias("col_a"), F.col("ordinal").alias("ord_a"), "class", "value")
    b = samples.select(F.col("unit_id").alias("unit_b"), F.col("col").alias("col_b"), F.col("ordinal").alias("ord_b"), "class", "value")
    shared = a.join(b, ["class", "value"]).where("unit_a <> unit_b").groupBy("unit_a", "col_a", "ord_a", "unit_b", "col_b", "ord_b").agg(F.count(F.lit(1)).alias("n_shared"))
    sized = shared.join(F.broadcast(cards.select(F.col("unit_id").alias("unit_a"), F.col("col").alias("col_a"), "card")), ["unit_a", "col_a"])
    return sized.withColumn("containment", F.col("n_shared") / F.col("card")).drop("card")


def proposals(samples: DataFrame, stats: DataFrame, top_pairs: int = 1, role_gate: bool = True) -> DataFrame:
    """The best column pairs of every two units: name similarity plus containment, a trifle more if both are keys.

    Measures are kept out by the role gate. Of equal ranks the first columns in schema order win.
    """
    roles = stats.select("unit_id", "col", "role", "is_key")
    both = containment(samples)
    flipped = both.select(F.col("unit_a").alias("unit_b"), F.col("col_a").alias("col_b"), F.col("unit_b").alias("unit_a"), F.col("col_b").alias("col_a"), F.col("containment").alias("back"))
    pairs = both.where("unit_a < unit_b").join(flipped, ["unit_a", "col_a", "unit_b", "col_b"])
    for side in ("a", "b"):
        pairs = pairs.join(F.broadcast(roles.select(F.col("unit_id").alias(f"unit_{side}"), F.col("col").alias(f"col_{side}"), F.col("role").alias(f"role_{side}"), F.col("is_key").alias(f"key_{side}"))), [f"unit_{side}", f"col_{side}"])
    if role_gate:
        pairs = pairs.where("role_a <> 'measure' and role_b <> 'measure'")
    name = X.name_similarity(F.col("col_a"), F.col("col_b"))
    ranked = pairs.withColumn("name_sim", name).withColumn("best", F.greatest("containment", "back"))
    ranked = ranked.withColumn("rank", F.col("name_sim") + F.col("best") + F.when(F.col("key_a") & F.col("key_b"), 1e-6).otherwise(0.0))
    order = Window.partitionBy("unit_a", "unit_b").orderBy(F.desc("rank"), "ord_a", "ord_b")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_pairs).select("unit_a", "col_a", "unit_b", "col_b", "name_sim", F.col("best").alias("containment"), "rank", "place")


def _comparable(a: DataFrame, ca: str, b: DataFrame, cb: str) -> tuple[Column, Column]:
    same = a.schema[ca].dataType == b.schema[cb].dataType
    return (F.col(ca), F.col(cb)) if same else (F.col(ca).cast("string"), F.col(cb).cast("string"))


def key_counts(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    """k, ca, cb: rows of each side by join key, keys of both sides only. Columns of unlike type meet as text."""
    ka, kb = _comparable(a, ca, b, cb)
    left = a.where(F.col(ca).isNotNull()).groupBy(ka.alias("k")).agg(F.count(F.lit(1)).alias("ca"))
    right = b.where(F.col(cb).isNotNull()).groupBy(kb.alias("k")).agg(F.count(F.lit(1)).alias("cb"))
    return left.join(right, "k")


def join_probe(a: DataFrame, ca: str, b: DataFrame, cb: str, limit: int | None = 10) -> DataFrame:
    """k, n: joined rows by key, most first."""
    out = key_counts(a, ca, b, cb).select("k", (F.col("ca") * F.col("cb")).alias("n")).orderBy(F.desc("n"), "k")
    return out if limit is None else out.limit(limit)


def join_probe_naive(a: DataFrame, ca: str, b: DataFrame, cb: str, limit: int | None = 10) -> DataFrame:
    """The same result from the joined rows themselves; kept to check the other form."""
    ka, kb = _comparable(a, ca, b, cb)
    out = a.select(ka.alias("k")).join(b.select(kb.alias("k")), "k").groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k")
    return out if limit is None else out.limit(limit)


def fanout(a: DataFrame, ca: str, b: DataFrame, cb: str) -> DataFrame:
    """fanout_src, fanout_dst, pairs: the most joined rows of a key (the same either way), and the most rows a key has on each side."""
    counts = key_counts(a, ca, b, cb).agg(F.coalesce(F.max(F.col("ca") * F.col("cb")), F.lit(0)).alias("pairs"), F.coalesce(F.max("ca"), F.lit(0)).alias("side_src"), F.coalesce(F.max("cb"), F.lit(0)).alias("side_dst"))
    return counts.select(F.col("pairs").alias("fanout_src"), F.col("pairs").alias("fanout_dst"), "side_src", "side_dst")


def fanout_ok(src: int, dst: int, side_src: int, side_dst: int, declared: bool, mode: str = "pairs", most: int = FANOUT) -> bool:
    """An undeclared join passes unless both fan-outs exceed one and their product exceeds `most`."""
    if declared:
        return True
    x, y = (src, dst) if mode == "pairs" else (side_src, side_dst)
    return not (min(x, y) > 1 and x * y > most)


def fans_out(x: Column, y: Column, most: int = FANOUT) -> Column:
    """Both counts exceed one and their product, which 64 bits may not hold, exceeds `most`."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (F.least(x, y) > 1) & (wide(x) * wide(y) > most)


def counterfactual_join_ok(a: DataFrame, ca: str, b: DataFrame, cb: str, others_a: list[str], others_b: list[str], decoys: int = DECOYS) -> bool:
    """The join says something that swapping one end for another column of its class does not.

    At most `decoys` joins, each with one end replaced, all in one job; without any to try the
    join is rejected.
    """
    tries = [(x, cb) for x in others_a if x != ca] + [(ca, y) for y in others_b if y != cb]
    if not tries:
        return False
    union = None
    for i, (x, y) in enumerate(tries[:decoys]):
        probe = join_probe(a, x, b, y).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("k", "n").alias("distinct")).select(F.lit(i).alias("decoy"), "rows", "distinct")
        union = probe if union is None else union.unionByName(probe)
    return not union.where("rows >= 2 and distinct > 1").limit(1).count()


def value_counts(columns: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """unit, col, value, n: how often each value of the named columns of each unit occurs, as text; nulls are left out.

    A task sends one row for each column and value, so a hot value costs one row a column and task.
    """
    cells = []
    for unit, (df, names) in columns.items():
        kept = df.select(*[F.col(f"`{n}`") for n in names])
        cells.append(profile.unpivot(kept, kept.schema.fields).select(F.lit(unit).alias("unit"), "col", "value"))
    return reduce(DataFrame.unionByName, cells).groupBy("unit", "col", "value").agg(F.count(F.lit(1)).alias("n"))


def pair_facts(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, n_keys, pairs, side_src, side_dst of column pairs (pair, unit_a, col_a, unit_b, col_b): keys of both, most joined rows of a key, most rows of a key on each side.

    All pairs are aggregates of one table: the counts of a value are gathered once, one row a
    column, and met with each other there; pairs are a few hundred at most and broadcast. Pairs
    without a shared key have no row.
    """
    name = lambda unit, col: F.concat(F.col(unit), F.lit("\x00"), F.col(col))
    held = counts.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct(name("unit", "col"), "n"))).alias("held"))
    wanted = pairs.select("pair", name("unit_a", "col_a").alias("a"), name("unit_b", "col_b").alias("b"))
    met = held.where(F.size("held") > 1).select("held", F.explode("held").alias("a", "na")).join(F.broadcast(wanted), "a")
    met = met.select("pair", "na", F.col("held")[F.col("b")].alias("nb")).where("nb is not null")
    return met.groupBy("pair").agg(F.count(F.lit(1)).alias("n_keys"), F.max(F.col("na") * F.col("nb")).alias("pairs"), F.max("na").alias("side_src"), F.max("nb").alias("side_dst"))


def literal_lookup(df: DataFrame, column: str, values: list, limit: int | None = 20) -> DataFrame:
    """column, n: rows of the listed values, most first."""
    out = df.where(F.col(column).isin(*values)).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out if limit is None else out.limit(limit)
