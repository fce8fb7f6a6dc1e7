"""One-pass table profiles.

A table is read three times whatever its width: once for counts of rows and nulls of all
columns, once for the head sample's statistics (a bounded number of rows), once for the top
categories of all text columns together, which are unpivoted before one grouping.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import semantics
from tessera.session import within

SAMPLE_ROWS, SAMPLE_VALUES, TOP_CATEGORIES, ENTITY_TOKENS, VALUE_SAMPLE = 500, 20, 3, 32, 200
#: Counters of a task's summary of a column, and values of a column that are counted exactly after it.
COUNTERS, SURVIVORS = 512, 1024


def flat_columns(df: DataFrame) -> list[T.StructField]:
    """The columns that are profiled: nested ones are not."""
    return [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def head(df: DataFrame, order: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows by a stated order, so that a sample is the same on every run."""
    return df.orderBy(*order).limit(rows)


def text_form(name: str, kind: T.DataType) -> Column:
    """A value's text form; doubles without exponents, so equal numbers read alike across engines."""
    c = F.col(f"`{name}`")
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "") if isinstance(kind, (T.DoubleType, T.FloatType)) else c.cast("string")


def unpivot(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """Rows (ordinal, col, value) of the named columns, nulls left out."""
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("col"), text_form(f.name, f.dataType).alias("value")) for i, f in enumerate(fields)])
    return df.select(F.explode(cells).alias("c")).select("c.*").where("value is not null")


def null_rates(df: DataFrame) -> DataFrame:
    """col, n_rows, n_null, null_rate of every column, from one aggregation over the whole table."""
    fields = flat_columns(df)
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("col"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"c{i}")).alias("n_null")) for i, f in enumerate(fields)])
    return counted.select(F.explode(rows).alias("r")).select("r.*").withColumn("null_rate", F.col("n_null") / F.greatest(F.col("n_rows"), F.lit(1)))


def head_stats(df: DataFrame, order: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """col, sample_n, distinct_ratio, variance, min, max and up to SAMPLE_VALUES values, from the head sample."""
    fields = flat_columns(df)
    sample = head(df.select(*{f"`{c}`": None for c in (*[f.name for f in fields], *order)}), order, rows)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        number = c.cast("double") if semantics.is_numeric(f.dataType) else F.lit(None).cast("double")
        aggs += [
            F.size(F.collect_set(text_form(f.name, f.dataType))).alias(f"d{i}"),
            F.var_pop(number).alias(f"v{i}"),
            F.min(number).alias(f"l{i}"),
            F.max(number).alias(f"h{i}"),
            F.slice(F.array_sort(F.collect_set(text_form(f.name, f.dataType))), 1, SAMPLE_VALUES).alias(f"s{i}"),
        ]
    one = sample.agg(*aggs)
    out = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(f.name).alias("col"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"),
                F.lit(semantics.is_numeric(f.dataType)).alias("is_numeric"), F.lit(semantics.is_date(f.name, f.dataType)).alias("is_date"),
                F.col("n").alias("sample_n"), (F.col(f"d{i}") / F.greatest(F.col("n"), F.lit(1))).alias("distinct_ratio"),
                F.col(f"v{i}").alias("variance"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), F.col(f"s{i}").alias("sample_values"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return one.select(F.explode(out).alias("r")).select("r.*")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A Misra-Gries summary of each column of a task: at most COUNTERS values with lower bounds of their counts, and a null one with what any value may lack."""
    held: dict[int, Counter] = {}
    lacks: Counter = Counter()
    for batch in batches:
        for i, column in enumerate(batch.columns):
            own = held.setdefault(i, Counter())
            counts = pc.value_counts(column.drop_null())
            own.update(dict(zip(counts.field(0).to_pylist(), counts.field(1).to_pylist())))
            if len(own) > COUNTERS:
                least = sorted(own.values(), reverse=True)[COUNTERS]
                lacks[i] += least
                held[i] = Counter({v: n - least for v, n in own.items() if n > least})
    for i, own in held.items():
        values, n = [None, *own], [lacks[i], *own.values()]
        yield pa.record_batch([pa.array([i] * len(n), pa.int32()), pa.array(values, pa.string()), pa.array(n, pa.int64())], ["ordinal", "value", "n"])


def frequent(cells: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Of columns c0, c1, ... the values that may be among the first `most` (ordinal, value), and the columns that summaries do not decide (ordinal).

    A value's count lies between its merged counter and that plus what its column lacks. What is
    below the most-th largest counter is out; where values without a counter may reach that, or
    over SURVIVORS values are left, the column is undecided.
    """
    merged = cells.mapInArrow(_summaries, "ordinal int, value string, n bigint").groupBy("ordinal", "value").agg(F.sum("n").alias("n"))
    lacks = F.max(F.when(F.col("value").isNull(), F.col("n"))).over(Window.partitionBy("ordinal"))
    place = F.row_number().over(Window.partitionBy("ordinal").orderBy(F.col("value").isNull(), F.desc("n"), "value"))
    bounded = merged.withColumn("lacks", lacks).withColumn("place", place).where((F.col("place") <= SURVIVORS + 1) | F.col("value").isNull())
    ranked = bounded.where("value is not null")
    bar = ranked.groupBy("ordinal").agg(F.max(F.when(F.col("place") == most, F.col("n"))).alias("bar"), F.max(F.when(F.col("place") > SURVIVORS, F.col("n"))).alias("beyond"))
    about = bounded.where("value is null").select("ordinal", "lacks").join(bar, "ordinal", "left")
    few = F.col("bar").isNull()  # fewer values than asked for: all have counters unless some were dropped
    open_ = (few & (F.col("lacks") > 0)) | (F.col("lacks") >= F.col("bar")) | (F.col("beyond") + F.col("lacks") >= F.col("bar"))
    about = about.withColumn("open", F.coalesce(open_, F.lit(False)))
    kept = ranked.drop("lacks").join(F.broadcast(about), "ordinal").where(~F.col("open") & (few | (F.col("n") + F.col("lacks") >= F.col("bar"))))
    return kept.select("ordinal", "value"), about.where("open").select("ordinal")


def top_categories(df: DataFrame, most: int = TOP_CATEGORIES) -> DataFrame:
    """ordinal, col, value, n, rank: the most frequent values of the columns that are not numeric, over the whole table; ties by value.

    Each task summarises its columns in COUNTERS counters; only values that these leave in the
    running are counted exactly, where they lie. A column of nearly unlike values is not decided
    so and is counted in full, which shuffles its distinct values.
    """
    fields = [f for f in flat_columns(df) if not semantics.is_numeric(f.dataType)]
    if not fields:
        return df.sparkSession.createDataFrame([], "ordinal int, col string, value string, n bigint, rank int")
    cells = df.select(*[text_form(f.name, f.dataType).alias(f"c{i}") for i, f in enumerate(fields)])
    kept, undecided = frequent(cells, most)
    rows = unpivot(df, fields)
    counted = rows.join(F.broadcast(kept), ["ordinal", "value"], "left_semi").unionByName(rows.join(F.broadcast(undecided), "ordinal", "left_semi"))
    counted = counted.groupBy("ordinal", "col", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("col").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def column_stats(df: DataFrame, unit_id: str, order: Sequence[str], title: str = "") -> DataFrame:
    """The profile of one table: a row per column with its role and value kind."""
    tops = top_categories(df).groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("top_categories"))
    stats = head_stats(df, order).join(F.broadcast(null_rates(df).drop("ordinal")), "col").join(F.broadcast(tops), "col", "left")
    out = stats.select(F.lit(unit_id).alias("unit_id"), F.lit(title or unit_id).alias("title"), "*").withColumn("top_categories", F.coalesce("top_categories", F.array().cast("array<string>")))
    return semantics.with_semantics(out).withColumn("is_key", semantics.is_key_name(F.col("col")) | (F.col("distinct_ratio") >= semantics.KEY_RATIO))


def all_column_stats(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """column_stats of an environment: unit_id to (table, order of its head sample)."""
    return reduce(DataFrame.unionByName, [column_stats(df, name, order) for name, (df, order) in tables.items()])


def stats_within(tables: dict[str, tuple[DataFrame, Sequence[str]]], seconds: float) -> tuple[list[Row], list[str]]:
    """The rows of column_stats of the tables that could be profiled in so many seconds, and the names of the others.

    Tables are profiled one after another, their jobs cancelled when the time is over; what is
    complete is kept, of a table all or nothing. A row a column reaches the driver.
    """
    end, rows, late = time.monotonic() + seconds, [], []
    for name, (df, order) in tables.items():
        found = within(df.sparkSession, left, column_stats(df, name, order).collect) if (left := end - time.monotonic()) > 0 else None
        rows += found or []
        late += [name] if found is None else []
    return rows, late


def unit_stats(stats: DataFrame) -> DataFrame:
    """unit_id, n_rows, n_cols, has_date, has_num, keys (named keys first) and entity tokens."""
    named = semantics.is_key_name(F.col("col"))
    per = stats.groupBy("unit_id").agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        F.bool_or("is_date").alias("has_date"),
        F.bool_or("is_numeric").alias("has_num"),
        F.array_sort(F.collect_list(F.struct("ordinal", "col", named.alias("named"), (F.col("distinct_ratio") >= semantics.KEY_RATIO).alias("distinct"), "top_categories"))).alias("cols"),
    )
    names = lambda keep: F.transform(F.filter("cols", keep), lambda c: c["col"])
    words = F.concat(X.entity_tokens(F.col("unit_id")), F.flatten(F.transform("cols", lambda c: X.entity_tokens(c["col"]))), F.flatten(F.transform("cols", lambda c: F.flatten(F.transform(c["top_categories"], X.entity_tokens)))))
    return per.select(
        "unit_id", "n_rows", "n_cols", "has_date", "has_num",
        F.array_distinct(F.concat(names(lambda c: c["named"]), names(lambda c: c["distinct"]))).alias("keys"),
        F.slice(F.array_distinct(words), 1, ENTITY_TOKENS).alias("ent"),
    )


def value_samples(df: DataFrame, unit_id: str, most: int = VALUE_SAMPLE) -> DataFrame:
    """unit_id, ordinal, col, class, value: up to `most` distinct non-empty values of each column, the smallest first.

    A task keeps the smallest of its own rows as they pass, so at most `most` values a column and
    task are shuffled, whatever the table's size and its texts' length.
    """
    fields = flat_columns(df)
    cells = df.select(*[F.nullif(text_form(f.name, f.dataType), F.lit("")).alias(f"c{i}") for i, f in enumerate(fields)])
    schema = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("value", T.StringType())])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pa.Array] = {}
        for batch in batches:
            for i, column in enumerate(batch.columns):
                own = pc.unique(column.drop_null())
                met = pc.unique(pa.concat_arrays([kept[i], own])) if i in kept else own
                kept[i] = met.take(pc.sort_indices(met)[:most])
        for i, values in kept.items():
            yield pa.record_batch([pa.array([i] * len(values), pa.int32()), values.cast(pa.string())], ["ordinal", "value"])

    values = cells.mapInArrow(smallest, schema).distinct()
    first = values.withColumn("_r", F.row_number().over(Window.partitionBy("ordinal").orderBy("value"))).where(F.col("_r") <= most)
    named = F.element_at(F.array(*[F.lit(f.name) for f in fields]), F.col("ordinal") + 1)
    kind = F.element_at(F.array(*[F.lit("num" if semantics.is_numeric(f.dataType) else "text") for f in fields]), F.col("ordinal") + 1)
    return first.select(F.lit(unit_id).alias("unit_id"), "ordinal", named.alias("col"), kind.alias("class"), "value")


def diversity_sample(units: DataFrame, most: int = 40) -> DataFrame:
    """At most `most` units: the largest of each format, then the 8 largest, the 8 smallest of three rows or more, then by rows."""
    by_format = Window.partitionBy("format").orderBy(F.desc("n_rows"), "unit_id")
    down, up = Window.orderBy(F.desc("n_rows"), "unit_id"), Window.orderBy(F.when(F.col("n_rows") >= 3, 0).otherwise(1), "n_rows", "unit_id")
    ranked = units.select("*", F.row_number().over(by_format).alias("_f"), F.row_number().over(down).alias("_d"), F.row_number().over(up).alias("_u"))
    tier = F.when(F.col("_f") == 1, 0).when(F.col("_d") <= 8, 1).when((F.col("_u") <= 8) & (F.col("n_rows") >= 3), 2).otherwise(3)
    return ranked.orderBy(tier, F.desc("n_rows"), "unit_id").limit(most).select(*units.columns)
