"""Types of text columns from all their values, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHOLE = r"^\s*[+-]?\d+\s*$"
_REAL = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)\s*$"


def facts(value: Column) -> Column:
    """What decides the type of a text column, as one struct over all its values: n, whole, real, digits."""
    v = F.when(F.trim(value) != "", value)
    return F.struct(
        F.count(v).alias("n"),
        F.bool_and(F.regexp_like(v, F.lit(_WHOLE))).alias("whole"),
        F.bool_and(F.regexp_like(v, F.lit(_REAL))).alias("real"),
        F.max(F.length(F.regexp_replace(v, r"\D", ""))).alias("digits"),
    )


def typed(value: Column, seen) -> Column:
    """The column with the type that its facts decide."""
    if seen["n"] and seen["whole"]:
        return F.trim(value).try_cast("bigint" if seen["digits"] <= 18 else "decimal(38,0)")
    if seen["n"] and seen["real"]:
        return F.trim(value).try_cast("double")
    return value


def infer_types(df: DataFrame) -> DataFrame:
    """Cast each text column: bigint if all its values are whole numbers, double if all are numbers, else text.

    Blank values decide nothing and become null in numeric columns. Whole numbers beyond 64
    bits make decimals. A column without values is text.
    """
    if not df.columns:
        return df
    seen = df.agg(*(facts(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(df.columns))).first()
    return df.select(*(typed(F.col(f"`{c}`"), seen[i]).alias(c) for i, c in enumerate(df.columns)))


def from_rows(spark, header: list[str], rows: list[list]) -> DataFrame:
    """A typed table from a header and text rows: empty rows are left out, short ones filled with nulls, long ones cut."""
    from tessera.sources.naming import unique_headers

    names = unique_headers(header)
    kept = [[None if v is None else str(v) for v in (*r, *[None] * len(names))][: len(names)] for r in rows if any(v not in (None, "") for v in r)]
    return infer_types(spark.createDataFrame(kept, ", ".join(f"`{n}` string" for n in names)))
