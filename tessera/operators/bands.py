"""Values near each other by an equi-join: a logarithmic grid, neighbouring cells, then the test itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

SHARE = 0.01
#: A fact within ZERO of nothing is near a value that is nothing to within NOTHING.
ZERO, NOTHING = 1e-6, 1e-9


def _cell(x: Column, share: float) -> Column:
    """The cell of a number that is not zero; a cell is as wide as the band below a value, so a band lies in three."""
    return F.floor(F.log(F.abs(x)) / F.lit(-math.log1p(-share) * (1 + 1e-9)))


def near(values: DataFrame, facts: DataFrame, by: list[str], value: str = "value", fact: str = "num", share: float = SHARE) -> DataFrame:
    """Rows of values (by, value, ...) and facts (by, fact, ...) that agree in `by` and whose fact is within `share` of the value.

    A value is looked up in its own cell and the two beside it, a fact lies in one cell, so each
    pair is met once and no value meets all facts. Nulls and what is not finite are near nothing.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    y, x = F.col(value), F.col(fact)
    side = lambda c: F.signum(c).cast("int")
    around = F.array(*[F.struct(side(y).alias("_side"), (_cell(y, share) + d).alias("_cell")) for d in (-1, 0, 1)])
    nothing = F.array(F.struct(F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_cell")))
    asked = values.where(finite(value)).withColumn("_at", F.explode(F.when(F.abs(y) < NOTHING, nothing).otherwise(around)))
    own = F.when(x == 0, F.array().cast("array<struct<_side:int,_cell:bigint>>")).otherwise(F.array(F.struct(side(x).alias("_side"), _cell(x, share).alias("_cell"))))
    held = facts.where(finite(fact)).withColumn("_at", F.explode(F.when(F.abs(x) < ZERO, F.concat(own, nothing)).otherwise(own)))
    return asked.join(held, [*by, "_at"]).where(X.close(x, y, share)).drop("_at")
