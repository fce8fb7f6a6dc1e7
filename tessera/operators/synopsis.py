"""What an environment is about: probes that gave rows, summed up by scope; scores of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPRESENTATIVE, ENTRY_UNITS = 3, 2
#: The kind of a task that the most frequent probe of its scope suggests.
KINDS = {"ranking": "comparison", "temporal": "temporal", "association": "attribution", "anomaly": "narrative", "cross_source": "attribution"}


def dominant_kind(anchors: DataFrame, scope: str = "scope") -> DataFrame:
    """scope, category, n, kind: the most frequent probe category; of equal ones that whose first anchor (by place) comes first.

    anchors are (scope, place, category). Counted by scope and category first, so a hot scope is
    one row a category before it meets.
    """
    counted = anchors.groupBy(scope, "category").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    best = counted.groupBy(scope).agg(F.max_by(F.struct("category", "n"), F.struct("n", -F.col("first"))).alias("b"))
    kind = F.coalesce(*[F.when(F.col("b.category") == c, k) for c, k in KINDS.items()], F.lit("comparison"))
    return best.select(scope, "b.category", "b.n", kind.alias("kind"))


def representative(anchors: DataFrame, scope: str = "scope", most: int = REPRESENTATIVE) -> DataFrame:
    """anchors (scope, place, n_rows, variance) with weight: the `most` of each scope with most rows times variance and one; ties by place."""
    weighed = anchors.withColumn("weight", F.col("n_rows") * (F.coalesce("variance", F.lit(0.0)) + 1))
    return _first(weighed, scope, [F.desc("weight"), F.col("place")], most)


def entry_units(units: DataFrame, scope: str = "scope", most: int = ENTRY_UNITS) -> DataFrame:
    """units (scope, unit_id, n_rows): the largest of each scope, ties by unit_id."""
    return _first(units, scope, [F.desc("n_rows"), F.col("unit_id")], most)


def best_per_tool(ranked: DataFrame, by: str, tool: str, score: str, tie: str) -> DataFrame:
    """The configuration of the highest score for each tool of each state."""
    return ranked.groupBy(by, tool).agg(F.max_by(F.struct(*ranked.columns), F.struct(score, -F.col(tie))).alias("b")).select("b.*")


def judge_score(overall: Column, dimensions: Column) -> Column:
    """A judge's overall score, else the mean of the dimensions that it scored, each between 0 and 1; 0 without any."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    scored = F.filter(dimensions, lambda d: d.isNotNull())
    mean = F.aggregate(scored, F.lit(0.0), lambda s, d: s + clip(d)) / F.size(scored)
    return F.when(overall.isNotNull(), clip(overall)).when(F.size(scored) > 0, mean).otherwise(0.0)


def _first(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    # Spark limits each group before the shuffle, so a hot group is `most` rows a task
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= most)
