"""Paths of one to three tables as DataFrame plans.

Bridges are plans, not values: an upstream probe is joined as it stands, so a change upstream
changes the answer. A source can be emptied by name, which the checks of dependence use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.probes import BRIDGE, CHAIN


def emptied(df: DataFrame, gone: bool = True) -> DataFrame:
    """The table with no rows and the same columns, which the optimiser folds away."""
    return df.where(F.lit(False)) if gone else df


def chain(probe: DataFrame, bridge_col: str, target: DataFrame, target_col: str, limit: int | None = CHAIN) -> DataFrame:
    """target_col, matching_rows: rows of the target for each key of the upstream probe.

    The join is a semi-join, so the target is counted without a shuffle of its rows where the
    probe is small enough for Spark to broadcast, as one with a limit is; any other probe joins
    by shuffle.
    """
    keys = probe.select(F.col(bridge_col).alias("_k"))
    met = target.join(keys, target[target_col] == F.col("_k"), "left_semi")
    out = met.groupBy(target_col).agg(F.count(F.lit(1)).alias("matching_rows")).orderBy(F.desc("matching_rows"), target_col)
    return out if limit is None else out.limit(limit)


def bridge(rows: DataFrame, key: str, most: int = BRIDGE) -> DataFrame:
    """k, support: the best supported keys."""
    kept = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("support"))
    return kept.orderBy(F.desc("support"), "k").limit(most)


def join_chain(a: DataFrame, a_col: str, b: DataFrame, b_col: str, key: str, c: DataFrame, c_col: str, limit: int | None = CHAIN) -> DataFrame:
    """Three tables, join then chain: the keys of the joined pair that have most rows look up the third.

    Only counts by join key are taken of the first table before it meets the second.
    """
    left = a.where(F.col(a_col).isNotNull()).groupBy(F.col(a_col).alias("_j")).agg(F.count(F.lit(1)).alias("_n"))
    met = b.where(F.col(key).isNotNull()).join(left, F.col(b_col) == F.col("_j"))
    keys = met.groupBy(F.col(key).alias("k")).agg(F.sum("_n").alias("support")).orderBy(F.desc("support"), "k").limit(BRIDGE)
    return chain(keys, "k", c, c_col, limit)


def chain_chain(probe: DataFrame, probe_col: str, b: DataFrame, b_col: str, key: str, c: DataFrame, c_col: str, limit: int | None = CHAIN) -> DataFrame:
    """Three tables, chain then chain: rows of the second that the probe selects give the keys that look up the third."""
    upstream = probe.select(F.col(probe_col).alias("_u"))
    met = b.join(upstream, F.col(b_col) == F.col("_u"), "left_semi")
    return chain(bridge(met, key), "k", c, c_col, limit)


def differs(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results are different multisets of rows."""
    return bool(a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count())
