"""How far the sources of a language differ in their words: a baseline and an inverted index of corrections.

Every source of a language gives each of the language's V kept terms a smoothed share p, in
billionths. Two sources differ by the sum of f = floor((p - q)**2 / (p + q)) over the kept terms.

1. Each task counts the terms of its documents by language and source, so a frequent word is one
   row a task and source before anything is shuffled. Kept terms have enough documents.
2. A pair of sources starts at V times f of two zero counts, as if it shared no term.
3. Corrections come from what is there alone. A source's terms that the other lacks depend on
   the source's counts only, so equal counts are taken together: one row for each source and
   count. Terms that both have are met through the postings of the term, and replace what each
   source alone had put in. Corrections of zero are not emitted.
4. The terms that a source has above its language's share are ranked by a window whose groups
   are cut to the ranks asked for before they are shuffled.

All numbers are integers; shares are worked out in decimals, so that no count overflows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import as_bytes, join_spread, materialise, shuffle_partitions, text_groups, text_parts

#: ASCII letters and all characters beyond ASCII, as UTF-8 bytes.
_TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")
LEAST_DOCS = 10
TOP_TERMS = 10
#: A task passes its counts on when it holds this many.
_HELD = 400_000

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _flush(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """One row for each language, source and term, and one without a term for each language and source."""
    for (lang, source), (n, docs) in counts.items():
        terms = [b"", *n]
        columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in text_groups(batches):
        for text, lang, source in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
            found = Counter(chain.from_iterable(map(_TERM.findall, text_parts(text.lower()))))
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(found)
            docs.update(found.keys())
            held += len(n) - before
        if held >= _HELD:
            yield from _flush(counts)
            counts, held = {}, 0
    yield from _flush(counts)


def _share(count: Column, total: Column, kept: Column) -> Column:
    """The smoothed share of a count, in billionths."""
    return F.lit(1) + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), F.greatest(total + 2 * kept, F.lit(1)).cast("decimal(20,0)"))


def _differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms (lang, source, term, n, p, zero, q, block) and the groups (lang, source, zero, kept).

    p is the share of the count n there, zero that of a count of nothing, q the language's share
    of the term, kept the number of kept terms of the language.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    counted = rows.mapInArrow(_count_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    posting = Window.partitionBy("lang", "term")
    whole = counted.withColumn("term_docs", F.sum("docs").over(posting)).withColumn("lang_n", F.sum("n").over(posting)).withColumn("lead", F.col("source") == F.min("source").over(posting))
    held = materialise(whole.where((F.col("term_docs") >= least_docs) | (F.col("term") == "")).withColumn("block", F.spark_partition_id()), "divergence-counts")
    terms = held.where("term <> ''")
    langs = terms.where("lead").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = held.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["kept", "total", "lang_total"]).withColumn("zero", _share(F.lit(0), F.col("total"), F.col("kept")))
    groups = materialise(groups, "divergence-groups")
    facts = groups.select(F.struct("lang", "source").alias("group"), "total", "kept", "lang_total", "zero")
    met = join_spread(terms.select(F.struct("lang", "source").alias("group"), "term", "n", "lang_n", "block"), facts, "group")
    shares = met.select("group.lang", "group.source", "term", "n", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "zero", _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return materialise(shares, "divergence-shares"), groups


def _others(left: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row of left beside every other source of its language; a language's rows are dealt to many tasks."""
    parts = shuffle_partitions(left.sparkSession)
    dealt = left.withColumn("part", F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int"))
    beside = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.hint("merge").join(beside, ["lang", "part"]).where("source <> item").drop("part")


def source_pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language."""
    zero = _differ(F.col("zero"), F.col("item_zero"))
    baseline = _others(groups.select("lang", "source", "zero", "kept"), groups).select("lang", "source", "item", (F.col("kept") * F.when(F.col("kept") > 0, zero).otherwise(0)).alias("value"))
    alike = shares.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("terms"))
    alone = _others(alike, groups).select("lang", "source", "item", (F.col("terms") * (_differ(F.col("p"), F.col("item_zero")) - zero)).alias("value")).where("value <> 0")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mine = shares.select("lang", "term", "source", "p", "zero")
    yours = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("zero").alias("item_zero"))
    both = _differ(F.col("p"), F.col("item_p")) - _differ(F.col("p"), F.col("item_zero")) - _differ(F.col("zero"), F.col("item_p")) + zero
    shared = mine.hint("merge").join(yours, ["lang", "term"]).where("source < item").select("lang", "source", "item", both.alias("value")).where("value <> 0")
    shared = shared.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    mirror = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return baseline.unionByName(mirror(alone)).unionByName(mirror(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank: part "pair" ranks all other sources of the language by their distance, part "term" the source's own terms.

    Null texts, languages and sources are empty ones, and an empty source or language is one
    like any other. A source without kept terms is compared by its shares of zero counts; where a
    language keeps no term all its distances are zero. Equal values are ranked by the item in
    UTF-8 order. Rows that repeat count each time, their ids are not looked at. Texts of any
    length are read whole. Other columns are ignored, whatever their names. An empty table gives
    no rows.
    """
    shares, groups = kept_counts(docs, text_col, lang_col, source_col, least_docs)
    pairs = source_pairs(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    own = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _differ(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


ORACLE = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
    k AS (SELECT lang, term, count(DISTINCT r) AS docs, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    totals AS (SELECT c.lang, source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(totals.total, 0) + 2 * langs.v)::HUGEINT AS p,
                 1 + (1000000000::HUGEINT * (k.n + 2)) // (langs.total + 2 * langs.v)::HUGEINT AS q
          FROM g JOIN k USING (lang) JOIN langs USING (lang) LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    own AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
    SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
    WHERE part = 'pair' OR rank <= 10
"""
