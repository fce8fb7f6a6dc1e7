"""Checks that a task's answer key must pass before the task is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import labels
from tessera.operators.probes import KEY_ROW_CAP, fingerprint
from tessera.operators.semantics import is_numeric

KEY_TOLERANCE, GUESS_TOLERANCE = 0.01, 0.10
#: Labels that anyone would guess.
GUESSABLE_LABELS = ("0", "1", "yes", "no", "true", "false")


def answer_key(result: DataFrame, cap: int = KEY_ROW_CAP) -> DataFrame | None:
    """label, value, raw of an uncapped result of one or two columns; None where it is too long, or of another shape.

    Of two columns the second must be numeric and without nulls.
    """
    fields = result.schema.fields
    if len(fields) not in (1, 2) or len(fields) == 2 and not is_numeric(fields[1].dataType):
        return None
    if result.limit(cap).count() >= cap:
        return None
    first = F.col(f"`{fields[0].name}`")
    if len(fields) == 1:
        number = is_numeric(fields[0].dataType)
        label = F.lit(None).cast("string") if number else first.cast("string")
        return result.select(label.alias("label"), (first.cast("double") if number else F.lit(None).cast("double")).alias("value"), first.cast("string").alias("raw"))
    second = F.col(f"`{fields[1].name}`")
    key = result.select(first.cast("string").alias("label"), second.cast("double").alias("value"), second.cast("string").alias("raw"))
    return None if key.where("value is null").limit(1).count() else key


def guessable(keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """guessable: every value is 0 or 1, or without values every label is a yes or no; an empty key is."""
    values = F.count("value") > 0
    coin = F.bool_and(F.col("value").isin(0.0, 1.0))
    plain = F.bool_and(F.lower(F.trim("label")).isin(*GUESSABLE_LABELS))
    verdict = F.when(F.count(F.lit(1)) == 0, True).when(values, coin).otherwise(F.coalesce(plain, F.lit(False)))
    grouped = keys.groupBy(*by) if by else keys.groupBy()
    return grouped.agg(verdict.alias("guessable"))


def rank_margin(result: DataFrame, value: str, order: list[Column], k: int, tolerance: float = KEY_TOLERANCE) -> DataFrame:
    """vk, vk1, margin_ok: whether the value at rank k and the one after it differ by more than the tolerance.

    Only the first k + 1 rows are ranked. With k rows or fewer the margin holds.
    """
    ranked = result.orderBy(*order).limit(k + 1).withColumn("_r", F.row_number().over(Window.orderBy(*order))).where(F.col("_r").isin(k, k + 1))
    pair = ranked.agg(F.max(F.when(F.col("_r") == k, F.col(value).cast("double"))).alias("vk"), F.max(F.when(F.col("_r") == k + 1, F.col(value).cast("double"))).alias("vk1"))
    scale = F.greatest(F.abs("vk"), F.abs("vk1"), F.lit(1e-9))
    return pair.withColumn("margin_ok", F.coalesce(F.abs(F.col("vk") - F.col("vk1")) / scale > tolerance, F.lit(True)))


def question_types(key: DataFrame) -> DataFrame:
    """types: comparison with two labelled groups or more and a measure, verification with a measure."""
    seen = key.agg((F.count("value") > 0).alias("m"), F.count(F.when(F.col("label").isNotNull(), 1)).alias("g"))
    return seen.select(F.filter(F.array(F.when(F.col("m") & (F.col("g") >= 2), "comparison"), F.when(F.col("m"), "verification")), lambda x: x.isNotNull()).alias("types"))


def decoy_reproducible(key: DataFrame, stats: DataFrame, touched: list[str], tolerance: float = KEY_TOLERANCE) -> DataFrame:
    """reproducible: every key row's label and value stand in the samples of units that the path does not touch."""
    others = stats.where(~F.col("unit_id").isin(*touched)) if touched else stats
    labels = others.select(F.explode("top_categories").alias("l")).select(F.lower("l").alias("l")).distinct()
    numbers = others.select(F.explode("sample_values").alias("s")).select(F.replace("s", F.lit(","), F.lit("")).try_cast("double").alias("s")).where("s is not null").distinct()
    # samples hold a few dozen values a column of an environment of bounded size
    gathered = labels.agg(F.collect_list("l").alias("ls")).join(F.broadcast(numbers.agg(F.collect_list("s").alias("ns"))))
    tested = key.join(F.broadcast(gathered))
    label_ok = F.col("label").isNull() | F.array_contains("ls", F.lower(F.col("label")))
    value_ok = F.col("value").isNull() | F.exists("ns", lambda s: F.abs(F.col("value") - s) <= tolerance * F.greatest(F.abs("value"), F.abs(s), F.lit(1e-9)))
    known = (F.size("ls") > 0) | (F.size("ns") > 0)
    return tested.agg(F.coalesce(F.bool_and(known & label_ok & value_ok), F.lit(False)).alias("reproducible"))


def leaks(texts: DataFrame, text: str, hidden: list[str]) -> DataFrame:
    """texts with leaks: whether a hidden value stands in them as a token; one pass over a text finds them all."""
    return texts.withColumn("leaks", labels.holds_any(F.col(text), hidden))


def hidden_values(key: DataFrame) -> list[str]:
    """The labels and values of an answer key (at most KEY_ROW_CAP rows) as texts that a question must not hold."""
    out: list[str] = []
    for r in key.limit(KEY_ROW_CAP).collect():
        if (r["label"] or "").strip():
            out.append(r["label"].strip())
        if r["value"] is not None:
            out.append(str(r["value"]))
            if float(r["value"]).is_integer():
                out.append(str(int(r["value"])))
    return list(dict.fromkeys(out))


def stable(run) -> bool:
    """Two runs of a plan builder give the same rows."""
    first, second = (fingerprint(run()).first()["signature"] for _ in range(2))
    return first == second


def accessible(spark, table: str) -> bool:
    return spark.catalog.tableExists(table)


def solvable(anchors: list, units: int, base_steps: int = 3) -> bool:
    """A plain script (list tables, read up to two schemas, run each anchor) ends within its steps with rows from each."""
    steps = 1 + min(2, units)
    for run in anchors:
        steps += 1
        if steps > base_steps + units or not run().limit(1).count():
            return False
    return bool(anchors)


def guessed(reply: str, key: list[tuple[str | None, float | None]], tolerance: float = GUESS_TOLERANCE) -> bool:
    """A reply states a key number within the tolerance, or a key label."""
    import re

    numbers = [float(x.replace(",", "")) for x in re.findall(r"-?\d[\d,]*(?:\.\d+)?", reply or "")]
    low = (reply or "").lower()
    for label, value in key:
        if value is not None and any(abs(n - value) <= tolerance * max(abs(value), 1e-9) for n in numbers):
            return True
        if value is None and label and label.lower() in low:
            return True
    return False


def spans(nodes: list[str], formats: list[str]) -> tuple[float, float]:
    """source_span and format_span of a path."""
    return len(set(nodes)) / 3, len(set(formats)) / 4


KEY_SCHEMA = T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("raw", T.StringType())])
