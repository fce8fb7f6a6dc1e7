"""Single-table probes: the small grouped questions that tell what a table is about.

Every probe carries its key as a tie-break, so a limited result is the same on every run, and
takes its limit as a parameter: None gives the uncapped answer query of the same probe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import profile, semantics

TOP, DATES, CHAIN, BRIDGE = 10, 20, 20, 8
KEY_ROW_CAP = 2000


@dataclass(frozen=True)
class Probe:
    """What a probe groups and measures; run() builds its plan."""

    kind: str
    keys: tuple[str, ...]
    measure: str | None = None

    def run(self, df: DataFrame, limit: int | None | str = "default") -> DataFrame:
        limit = self.most() if limit == "default" else limit
        if self.kind == "ranking":
            return ranking(df, self.keys[0], limit)
        if self.kind == "temporal":
            return temporal(df, self.keys[0], self.measure, limit)
        return association(df, self.keys, self.measure, limit)

    def order(self, result: DataFrame) -> list[Column]:
        """How run() orders its two columns: dates ascending, else the measure descending with the key as tie-break."""
        key, value = result.columns
        return [F.col(key)] if self.kind == "temporal" else [F.desc(value), F.col(key)]

    def most(self) -> int:
        """The limit of run()."""
        return DATES if self.kind == "temporal" else TOP

    def clause(self, humanised=lambda s: s.replace("_", " ").lower()) -> str:
        """What the probe reports, in words."""
        first = humanised(self.keys[0])
        if self.kind == "association" and self.measure:
            return f"report the average {humanised(self.measure)} for every {first}"
        if self.kind == "temporal" and self.measure:
            return f"report the total {humanised(self.measure)} for every {first}"
        if len(self.keys) > 1:
            return f"report the record count for every {first} and {humanised(self.keys[1])} pair"
        return f"report the record count for every {first}"


def _cap(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def ranking(df: DataFrame, key: str, limit: int | None = TOP) -> DataFrame:
    """key, n: rows per category, most first."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return _cap(counted.orderBy(F.desc("n"), key), limit)


def temporal(df: DataFrame, date: str, measure: str | None, limit: int | None = DATES) -> DataFrame:
    """date, total of the measure (decimal sums, so the order of addition is of no effect) or n without one, earliest first."""
    kept = df.where(F.col(date).isNotNull())
    if measure is None:
        return _cap(kept.groupBy(date).agg(F.count(F.lit(1)).alias("n")).orderBy(date), limit)
    kind = df.schema[measure].dataType
    total = F.sum(F.col(measure).cast("decimal(28,6)")).cast("double") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.sum(measure)
    return _cap(kept.groupBy(date).agg(total.alias("total")).orderBy(date), limit)


def association(df: DataFrame, keys: tuple[str, ...], measure: str | None, limit: int | None = TOP) -> DataFrame:
    """label, avg_v: mean of the measure per category; without one, label, n of pairs of categories."""
    if measure is not None:
        kept = df.where(F.col(keys[0]).isNotNull() & F.col(measure).isNotNull())
        mean = (F.sum(F.col(measure).cast("decimal(28,6)")).cast("double") / F.count(F.lit(1))).alias("avg_v")
        return _cap(kept.groupBy(F.col(keys[0]).alias("label")).agg(mean).orderBy(F.desc("avg_v"), "label"), limit)
    first, second = keys
    kept = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    pairs = kept.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    return _cap(pairs.select(F.concat(F.col(first).cast("string"), F.lit(" / "), F.col(second).cast("string")).alias("label"), "n").orderBy(F.desc("n"), "label"), limit)


def choose(df: DataFrame, ratios: dict[str, float]) -> list[Probe]:
    """The probes that a table's profile allows, cheapest first: ranking, temporal, association.

    ratios are the columns' head-sample distinct ratios. Columns are taken in schema order.
    """
    fields = profile.flat_columns(df)
    categories = [f.name for f in fields if not semantics.is_numeric(f.dataType) and not semantics.is_date(f.name, f.dataType) and 0 < ratios.get(f.name, 0) < semantics.CATEGORY_RATIO]
    dates = [f.name for f in fields if semantics.is_date(f.name, f.dataType)]
    numbers = [f.name for f in fields if semantics.is_numeric(f.dataType)]
    out = []
    if categories:
        out.append(Probe("ranking", (categories[0],)))
    if dates:
        out.append(Probe("temporal", (dates[0],), next((n for n in numbers if n != dates[0]), None)))
    if categories and numbers:
        out.append(Probe("association", (categories[0],), numbers[0]))
    elif len(categories) > 1:
        out.append(Probe("association", (categories[0], categories[1])))
    return out


def bridge_probe(probes: list[Probe], roles: dict[str, str]) -> Probe | None:
    """The probe whose key bridges best to another table: identifier, entity, category, then time; measures never."""
    order = {"identifier": 0, "entity": 1, "category": 2, "time": 3}
    fit = [(order[roles[p.keys[0]]], i, p) for i, p in enumerate(probes) if roles.get(p.keys[0]) in order]
    return min(fit)[2] if fit else None


def everything(order: list[Column]) -> WindowSpec:
    """The order of an answer-sized result as a window."""
    return Window.partitionBy(F.lit(0)).orderBy(*order)


def nontrivial(result: DataFrame) -> DataFrame:
    """keep, n_rows, variance of a result: two rows or more, not all alike; variance of its first numeric column."""
    number = next((f.name for f in result.schema.fields if semantics.is_numeric(f.dataType)), None)
    spread = F.coalesce(F.var_pop(F.col(number).cast("double")), F.lit(0.0)) if number else F.lit(0.0)
    checked = result.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*result.columns)).alias("_d"), spread.alias("variance"))
    return checked.select(((F.col("n_rows") >= 2) & (F.col("_d") > 1)).alias("keep"), "n_rows", "variance")


def fingerprint(result: DataFrame, digits: int = 12) -> DataFrame:
    """signature of a result: the first digits of the SHA-1 over its typed rows, sorted; results are answer-sized."""
    row = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in result.columns])
    return result.select(row.alias("r")).agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list("r")), "\n")), 1, digits).alias("signature"))
