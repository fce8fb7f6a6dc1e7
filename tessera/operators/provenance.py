"""Records of results: what an anchor found, what an answer's contract holds, and the key rows that either gives.

A record is one row, built by one aggregation over a result; only its first rows are kept, as a
stated number of labels and numbers, so a record is small whatever the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import admission, probes, semantics

ROWS, ROW_LABELS, ROW_NUMS, LABELS, NUMS, LONGEST = 12, 4, 8, 8, 12, 40


def _cells(result: DataFrame, numeric: bool) -> Column:
    """A row's cells as labels (neither blank nor long, and no number) or as numbers, in the order of the columns."""
    out = []
    for f in result.schema.fields:
        c = F.col(f"`{f.name}`")
        text = F.trim(c.cast("string"))
        number = F.replace(text, F.lit(","), F.lit("")).try_cast("double") if not semantics.is_numeric(f.dataType) else c.cast("double")
        fit = (text != "") & (F.length(text) <= LONGEST)
        out.append(F.when(fit, number) if numeric else F.when(fit & number.isNull(), text))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _first_of(rows: Column, name: str, most: int) -> Column:
    return F.slice(F.flatten(F.transform(rows, lambda r: r[name])), 1, most)


def record(result: DataFrame, order: list[Column], query: str, units: list[str], category: str, clause: str = "", composed: bool = False) -> DataFrame:
    """One row on a result: anchor, query, units, category, clause, composed, n_rows, variance, signature, rows, labels, nums. No row for an empty result.

    order is that of the result; rows are its first ROWS. Labels are told apart by their lower-case
    form. The anchor's id is a digest of the query.
    """
    first = result.select(F.struct(_cells(result, False).alias("labels"), _cells(result, True).alias("nums")).alias("r"), F.row_number().over(probes.everything(order)).alias("at")).where(F.col("at") <= ROWS)
    kept = first.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("rows"))
    cut = F.filter(F.transform("rows", lambda r: F.struct(F.slice(r["labels"], 1, ROW_LABELS).alias("labels"), F.slice(r["nums"], 1, ROW_NUMS).alias("nums"))), lambda r: (F.size(r["labels"]) > 0) | (F.size(r["nums"]) > 0))
    said = F.flatten(F.transform("rows", lambda r: r["labels"]))
    unlike = F.filter(said, lambda x, i: F.array_position(F.transform(said, F.lower), F.lower(x)) == i + 1)
    facts = probes.nontrivial(result).select("n_rows", "variance").join(F.broadcast(probes.fingerprint(result))).join(F.broadcast(kept))
    about = {"anchor": F.concat(F.lit("a_"), F.substring(F.sha1(F.lit(query)), 1, 10)), "query": F.lit(query), "units": F.array(*[F.lit(u) for u in units]), "category": F.lit(category), "clause": F.lit(clause), "composed": F.lit(composed)}
    return facts.where("n_rows > 0").select(*[c.alias(k) for k, c in about.items()], "n_rows", "variance", "signature", cut.alias("rows"), F.slice(unlike, 1, LABELS).alias("labels"), _first_of(F.col("rows"), "nums", NUMS).alias("nums"))


def contract(result: DataFrame, query: str, units: list[str], clause: str) -> DataFrame | None:
    """One row on the whole of an uncapped result: query, clause, units (each once), signature, n_rows, key_rows; None without a clause or where the result is no key."""
    key = admission.answer_key(result) if clause.strip() else None
    if key is None:
        return None
    rows = key.groupBy().agg(F.array_sort(F.collect_list(F.struct("label", "value"))).alias("key_rows"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 0")
    own = F.array(*[F.lit(u) for u in dict.fromkeys(units)])
    return rows.join(F.broadcast(probes.fingerprint(result))).select(F.lit(query).alias("query"), F.lit(clause.strip()).alias("clause"), own.alias("units"), "signature", "n_rows", "key_rows")


#: The shapes of provenance: a stated fact (label, value), rows of a result, or plain labels and numbers.
SHAPES = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("raw", T.StringType()),
        T.StructField("rows", T.ArrayType(T.StructType([T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("nums", T.ArrayType(T.DoubleType()))]))),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField("nums", T.ArrayType(T.DoubleType())),
    ]
)


def key_rows(provenance: DataFrame, by: list[str]) -> DataFrame:
    """by, label, value: the distinct key rows of provenance (by and the columns of SHAPES), of whichever shape each row has.

    A stated fact is itself; of a result each row's first label and number; of plain lists the
    first of each if both are there, else each of what is. Nulls and empty labels are left out.
    """
    fact = lambda label, value: F.struct(F.nullif(label, F.lit("")).alias("label"), value.cast("double").alias("value"))
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    found = (
        F.when(F.col("value").isNotNull() | F.col("raw").isNotNull(), F.array(fact(F.col("label"), F.col("value"))))
        .when(some("rows"), F.transform("rows", lambda r: fact(F.get(r["labels"], F.lit(0)), F.get(r["nums"], F.lit(0)))))
        .when(some("labels") & some("nums"), F.array(fact(F.get("labels", F.lit(0)), F.get("nums", F.lit(0)))))
        .when(some("nums"), F.transform("nums", lambda n: fact(nothing, n)))
        .when(some("labels"), F.transform("labels", lambda x: fact(x, none)))
    )
    return provenance.select(*by, F.explode(found).alias("f")).select(*by, "f.label", "f.value").where("label is not null or value is not null").distinct()
