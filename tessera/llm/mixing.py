"""Mixing sources to target weights, in DataFrame operations alone.

Sizes are words. Targets follow by filling to one level: each source takes its weight's share
of the whole until three times its own size, and the excess goes to the others by weight. A
source's repetition rate is target over size; a document is emitted floor(rate) times, and once
more by a Bernoulli draw with the fraction as its probability. The draw hashes the document
(its id and its text) with a seed. Sixteen seeds are weighed for each source, in one aggregation,
and the one whose draws come nearest to the target is used, so small sources are met closely too.

Rows meet their source's row of the plan without moving where the source is one of the LARGEST by
rows; these are broadcast. All other sources are small beside them, so no hot key is left for the
join by source that serves the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import materialise, unused

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
#: Seeds that are weighed for each source: each hash gives four 32-bit draws.
HASHES = 4
DRAWS = 4 * HASHES
#: This many sources, those with most rows, are broadcast (some 100 bytes each); every other has fewer than one row in so many.
LARGEST = 10_000


def _document(doc_id: Column, text: Column) -> Column:
    """What a draw hashes: a document's id and its text's checksum."""
    return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))


def _draw(j: int, document: Column) -> Column:
    """The j-th uniform draw of a document, from [0, 1)."""
    key = F.concat(F.lit(f"{j // 4}|"), document)
    return F.conv(F.substring(F.md5(key), 1 + 8 * (j % 4), 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn. Both windows run over
    one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("weight")).withColumn("level", most * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    total, total_weight = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    left = total - most * (F.sum("source_size").over(upto) - F.col("source_size"))
    share = ranked.withColumn("fill", left / (total_weight - F.sum("weight").over(upto) + F.col("weight")))
    filled = share.withColumn("water", F.min(F.when(F.col("fill") <= F.col("level"), F.struct("level", "source", "fill"))).over(whole)["fill"])
    return filled.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("water") * F.col("weight")).alias("target"))


def source_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], most: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes (doc_id, source, size, document), and one row per source: _mix, a struct of its rows, target, rate and seed."""
    source, text = F.col(source_col).cast("string"), F.col(text_col)
    sized = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _document(F.col(id_col).cast("long"), text).alias("document")
        ),
        "mix-sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = source_targets(sizes, weights, most).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    targets = targets.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    counted = sizes.select(F.col("source").alias("_s"), "rows")
    plan = materialise(targets.join(counted, F.col("source").eqNullSafe(F.col("_s"))).select(F.struct("source", "source_size", "target", "whole", "part", "rows").alias("_mix")), "mix-targets")
    drawn = _with_source(sized, plan, F.col("source"))
    gains = [F.sum(F.when(_draw(j, F.col("document")) < F.col("_mix.part"), F.col("size")).otherwise(0)).alias(f"g{j}") for j in range(DRAWS)]
    gained = drawn.groupBy("source", F.col("_mix.part").alias("part"), F.col("_mix.source_size").alias("source_size")).agg(*gains)
    off = [F.struct(F.abs(F.col(f"g{j}") - F.col("part") * F.col("source_size")).alias("off"), F.lit(j).alias("seed")) for j in range(DRAWS)]
    seeds = gained.select(F.col("source").alias("_s"), F.array_min(F.array(*off))["seed"].alias("seed"))
    seeded = plan.join(seeds, F.col("_mix.source").eqNullSafe(F.col("_s"))).select(F.col("_mix").withField("seed", F.col("seed")).alias("_mix"))
    return sized, materialise(seeded, "mix-plan")


def _with_source(rows: DataFrame, plan: DataFrame, source: Column, name: str = "_mix") -> DataFrame:
    """rows with their source's row of the plan in a column of that name; rows of the LARGEST sources do not move."""
    plan = plan.select(F.col("_mix").alias(name))
    head = F.broadcast(plan.orderBy(F.desc(F.col(name)["rows"]), F.col(name)["source"]).limit(LARGEST))
    same = source.eqNullSafe(F.col(name)["source"])
    tail = plan.join(head.select(F.col(name)["source"].alias("_h")), F.col(name)["source"].eqNullSafe(F.col("_h")), "left_anti")
    return rows.join(head, same).unionByName(rows.join(head, same, "left_anti").join(tail, same))


def _copies(document: Column, plan: Column) -> Column:
    """How often a document is taken by its source's row of the plan."""
    draw = F.coalesce(*[F.when(plan["seed"] == j, _draw(j, document)) for j in range(DRAWS)])
    return plan["whole"] + F.when(draw < plan["part"], 1).otherwise(0)


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, source.

    size counts words, 0 for a null or blank text; taken is size times copies. A null source is
    a source of its own, after all others. A source without words has target 0 and takes
    nothing. Rows that repeat both id and text draw alike; null ids draw by their texts. Reruns
    agree. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    sized, plan = source_plan(docs, id_col, text_col, source_col, weights, most)
    out = _with_source(sized, plan, F.col("source")).withColumn("copies", _copies(F.col("document"), F.col("_mix")))
    return out.select("doc_id", "size", F.col("_mix.source_size").alias("source_size"), F.col("_mix.target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """docs with every document as often as mixing_plan takes it; its columns, whatever their names, are unchanged.

    Nulls, blank texts, ties and repeats are as mixing_plan has them: a document of a source
    without words is not taken. Texts of the LARGEST sources are not shuffled. An empty table
    stays empty.
    """
    _, plan = source_plan(docs, id_col, text_col, source_col, weights, most)
    name, times, copy = unused(docs, "_mix"), unused(docs, "_mix_times"), unused(docs, "_mix_copy")
    taken = _with_source(docs, plan, docs[source_col].cast("string"), name)
    taken = taken.withColumn(times, _copies(_document(F.col(id_col).cast("long"), F.col(text_col)), F.col(name)).cast("int")).where(F.col(times) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(name, times, copy)


ORACLE = """
    WITH sized AS (SELECT doc_id, source, concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, ''))) AS document, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    ranked AS (SELECT source, source_size, ([1.0, 2.0, 3.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sizes),
    levels AS (SELECT *, 3 * source_size / weight AS level FROM ranked),
    sums AS (SELECT *, sum(source_size) OVER () AS s, sum(weight) OVER () AS w,
                    sum(source_size) OVER o AS cs, sum(weight) OVER o AS cw
             FROM levels WINDOW o AS (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    fills AS (SELECT *, (s - 3 * (cs - source_size))::DOUBLE / (w - cw + weight) AS fill FROM sums),
    water AS (SELECT arg_min(fill, (level, source)) AS water FROM fills WHERE fill <= level),
    targets AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, water * weight) AS target FROM fills, water),
    rates AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate FROM targets),
    hashed AS (SELECT doc_id, source, size, j, ('0x' || substr(md5((j // 4)::VARCHAR || '|' || document), 1 + 8 * (j % 4)::INT, 8))::BIGINT / 4294967296.0 AS u
               FROM sized, range(16) AS r(j)),
    drawn AS (SELECT h.*, r.source_size, r.target, floor(r.rate) AS whole, r.rate - floor(r.rate) AS part
              FROM hashed h JOIN rates r ON h.source IS NOT DISTINCT FROM r.source),
    gained AS (SELECT source, j, abs(sum(CASE WHEN u < part THEN size ELSE 0 END) - any_value(part * source_size)) AS off FROM drawn GROUP BY source, j),
    seeds AS (SELECT source, arg_min(j, (off, j)) AS seed FROM gained GROUP BY source)
    SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN u < part THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM drawn d JOIN seeds s ON d.source IS NOT DISTINCT FROM s.source AND d.j = s.seed
"""
