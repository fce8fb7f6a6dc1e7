"""Roles and value kinds of columns, as expressions over a column_stats DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns of names.
KEY_NAMES = r"(?i)(?:^id$|_id$|^sku$|_sku$|^code$|_code$|^date$|_date$|^region$|^customer$|_customer$|^product$|_product$|^order$|_order$|^key$|_key$)"
DATE_NAMES = r"(?i)date|time|year|month|day"
PERCENT_NAMES = r"(?i)pct|percent|rate|ratio|share"
MONEY_NAMES = r"(?i)price|cost|revenue|amount|salary|spend|budget|fee|usd|dollar"
COUNT_NAMES = r"(?i)count|number|qty|quantity|^num_|_num$"

KEY_RATIO, CATEGORY_RATIO, NAMED_KEY_RATIO = 0.95, 0.5, 0.5
PROPOSAL_COLUMNS = 8


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_date(name: str, kind: T.DataType) -> bool:
    import re

    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) or bool(re.search(DATE_NAMES, name))


def is_key_name(name: Column) -> Column:
    return F.regexp_like(name, F.lit(KEY_NAMES))


def role(name: Column, numeric: Column, date: Column, ratio: Column) -> Column:
    """time, identifier, measure, category or entity; the first rule that holds decides."""
    return (
        F.when(date, "time")
        .when(is_key_name(name) & (numeric | (ratio >= NAMED_KEY_RATIO)), "identifier")
        .when(ratio >= KEY_RATIO, "identifier")
        .when(numeric, "measure")
        .when((ratio > 0) & (ratio < CATEGORY_RATIO), "category")
        .otherwise("entity")
    )


def value_kind(name: Column, role_col: Column, low: Column, high: Column) -> Column:
    """id, percent, monetary, count or free."""
    measure = role_col == "measure"
    return (
        F.when(role_col == "identifier", "id")
        .when(measure & F.regexp_like(name, F.lit(PERCENT_NAMES)), "percent")
        .when(measure & low.isNotNull() & high.isNotNull() & (low >= 0) & (high <= 1), "percent")
        .when(measure & F.regexp_like(name, F.lit(MONEY_NAMES)), "monetary")
        .when(measure & F.regexp_like(name, F.lit(COUNT_NAMES)), "count")
        .otherwise("free")
    )


def with_semantics(stats: DataFrame) -> DataFrame:
    """Add role and value_kind to column_stats."""
    typed = stats.withColumn("role", role(F.col("col"), F.col("is_numeric"), F.col("is_date"), F.col("distinct_ratio")))
    return typed.withColumn("value_kind", value_kind(F.col("col"), F.col("role"), F.col("min"), F.col("max")))


def proposal_columns(stats: DataFrame, most: int = PROPOSAL_COLUMNS) -> DataFrame:
    """The columns of each unit that may join: keys in schema order, then the most distinct ones."""
    first = F.when(F.col("is_key"), F.col("ordinal").cast("double")).otherwise(-F.col("distinct_ratio"))
    order = Window.partitionBy("unit_id").orderBy(F.col("is_key").desc(), first, "ordinal")
    return stats.withColumn("proposal", F.row_number().over(order)).where(F.col("proposal") <= most)
