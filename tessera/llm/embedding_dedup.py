"""Embedding near-duplicates over a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Every pivot has an
inverted list of the vectors that hold it among their nearest. A pivot counts as shared by two
vectors if it stands at like places of both orders; vectors that share two are candidates, and
their cosine is then taken in double precision. Equal vectors are one entry with a count. A list
longer than a block is dealt as pairs of blocks, so a popular pivot makes more tasks, never a
longer one, and no candidate is dropped.

Vectors and pivots are described less the sample's mean, since embeddings of one model lean to
one side: so unrelated vectors are at right angles, whatever their cosine was. How many nearest
pivots describe a vector is fitted on pairs made from the sample at the very cosine of the
threshold, and on the links that the sample holds itself: the fewest that find TARGET of both.

Pivots: one for every PER_PIVOT distinct vectors, so lists stay of one length while vectors grow,
up to MOST_PIVOTS; beyond PER_PIVOT * MOST_PIVOTS vectors lists grow with them. They come from a
sample in hash order of twice as many vectors and are chosen far from one another, so a dense
group of near copies does not fill its neighbourhood with pivots. Many pivots are searched by
cells around the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import connected_components, join_spread, materialise

THRESHOLD = 0.9
#: Pivots that describe a vector at least and at most, and how many two vectors must share.
NEAREST, MOST_NEAREST = 8, 48
SHARED = 2
#: Share of the pairs it is fitted on that a description must find, and the most vectors and links of the sample for that.
TARGET = 0.98
FITTED, FITTED_LINKS = 2048, 4096
PER_PIVOT = 64
LEAST_PIVOTS, MOST_PIVOTS = 64, 32_768
#: Pivots that a vector is compared with at once; with more, only those of its nearest CELLS cells.
FLAT_PIVOTS = 1024
CELLS = 12
#: Vectors of a list that one task compares with as many others.
BLOCK = 2048


def choose_pivots(sample: np.ndarray, count: int, apart: float = 0.6) -> np.ndarray:
    """Up to count unit vectors of the sample, each with cosine below apart to those before it."""
    chosen = np.zeros((0, sample.shape[1]))
    for at in range(0, len(sample), 512):
        part = sample[at : at + 512]
        free = (part @ chosen.T < apart).all(axis=1)
        close = part @ part.T >= apart
        for i in range(len(part)):
            if free[i]:
                free[i + 1 :] &= ~close[i, i + 1 :]
        chosen = np.concatenate([chosen, part[free]])
        if len(chosen) >= count:
            break
    return chosen[:count]


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots as far apart as gives half of the wanted number, where the sample has so many."""
    for apart in (0.6, 0.75, 0.9):
        chosen = choose_pivots(sample, count, apart)
        if 2 * len(chosen) >= min(count, len(sample)):
            break
    return chosen


class PivotTable:
    """The nearest pivots of vectors less a mean, in order; by cells around the first pivots where there are many."""

    def __init__(self, pivots: np.ndarray, flat: int = FLAT_PIVOTS, cells: int = CELLS, *, mean: np.ndarray | None = None):
        self.pivots, self.cells = pivots, cells
        self.mean = np.zeros(pivots.shape[1]) if mean is None else mean
        self.k = self.gap = min(NEAREST, len(pivots))
        self.shared = min(SHARED, len(pivots))
        self.members: list[np.ndarray] = []
        if len(pivots) > flat:
            self.centers = pivots[: int(2 * len(pivots) ** 0.5)]
            home = np.concatenate([(pivots[a : a + 4096] @ self.centers.T).argmax(axis=1) for a in range(0, len(pivots), 4096)])
            order = np.argsort(home, kind="stable")
            self.members = np.split(order, np.searchsorted(home[order], np.arange(1, len(self.centers))))

    def fit(self, some: np.ndarray, threshold: float, shared: int) -> None:
        """The fewest nearest pivots, with places at most three quarters of them apart, that find TARGET of two kinds of pairs.

        One is a vector of the sample and the vector at the threshold's cosine on the way to the
        next of the sample; the other the links within the sample, which matter where many
        vectors lie closer than the mean tells. Where even MOST_NEAREST do not suffice, one
        shared pivot at any place does.
        """
        other = np.roll(some, 1, axis=0)
        aside = other - (some * other).sum(axis=1, keepdims=True) * some
        far = np.linalg.norm(aside, axis=1) > 1e-6
        most = min(MOST_NEAREST, len(self.pivots))
        self.shared = min(shared, most)
        if not far.any():
            return
        at = min(threshold, 1.0)
        near = self.nearest(some, most)
        moved = self.nearest(at * some[far] + (1 - at * at) ** 0.5 * _unit(aside[far]), most)
        u, v = np.nonzero(np.triu(some @ some.T >= threshold, 1))
        dealt = np.random.default_rng(0).permutation(len(u))[:FITTED_LINKS]
        kinds = [(near[far], moved), (near[u[dealt]], near[v[dealt]])]
        for k in range(min(NEAREST, most), most + 1, 2):
            self.k, self.gap = k, max(1, 3 * k // 4)
            if all(self._found(a[:, :k], b[:, :k]) >= TARGET for a, b in kinds if len(a)):
                return
        self.k = self.gap = most
        self.shared = 1

    def _found(self, a: np.ndarray, b: np.ndarray) -> float:
        """Share of the pairs that are candidates."""
        return sum((shared_places(a[i : i + 64], b[i : i + 64], self.gap).sum(axis=1) >= self.shared).sum() for i in range(0, len(a), 64)) / len(a)

    @staticmethod
    def _top(values: np.ndarray, k: int) -> np.ndarray:
        """Columns of the k largest values of each row, largest first."""
        k = min(k, values.shape[1])
        some = np.argpartition(-values, k - 1, axis=1)[:, :k]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(values, some, 1), axis=1, kind="stable"), 1)

    def nearest(self, unit: np.ndarray, k: int) -> np.ndarray:
        unit = _less(unit, self.mean)
        if not self.members:
            return self._top(unit @ self.pivots.T, k).astype(np.int32)
        best = np.full((len(unit), k * self.cells), -2.0)
        which = np.full((len(unit), k * self.cells), -1, dtype=np.int32)
        homes = self._top(unit @ self.centers.T, self.cells)
        for slot in range(homes.shape[1]):
            for cell in np.unique(homes[:, slot]):
                rows, own = np.flatnonzero(homes[:, slot] == cell), self.members[cell]
                if len(own):
                    values = unit[rows] @ self.pivots[own].T
                    top = self._top(values, k)
                    at = slot * k + np.arange(top.shape[1])
                    best[rows[:, None], at], which[rows[:, None], at] = np.take_along_axis(values, top, 1), own[top]
        return np.take_along_axis(which, self._top(best, k), 1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by the largest component first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _less(unit: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit vectors less the mean, scaled to length one again; one at the mean itself stays as it was."""
    if not mean.any():
        return unit
    rest = unit - mean
    length = np.linalg.norm(rest, axis=1, keepdims=True)
    return np.where(length > 1e-9, rest / np.maximum(length, 1e-9), unit)


def shared_places(p: np.ndarray, q: np.ndarray, gap: int) -> np.ndarray:
    """For each row and place of p, whether q has the same pivot at a place at most gap away."""
    places = np.arange(p.shape[1])
    return ((p[:, :, None] == q[:, None, :]) & (np.abs(places[:, None] - places) <= gap)).any(axis=2) & (p >= 0)


def _matrix(vectors: pa.Array) -> np.ndarray:
    lists = vectors.cast(pa.list_(pa.float64()))
    return lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].reshape(len(lists), -1)


def _lists(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            k = table.k
            near = table.nearest(_unit(_matrix(batch.column("embedding"))), k)
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            spread = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k), pa.int32()), pa.array(near.ravel()))
            out = pa.RecordBatch.from_arrays([pa.array(near.ravel()), batch.column("rep").take(each), batch.column("n").take(each), spread.take(each), batch.column("embedding").take(each)], names=["pivot", "rep", "n", "near", "embedding"])
            for at in range(0, out.num_rows, 4096):
                yield out.slice(at, 4096)

    return run


def _compare(shared: int, gap: int, threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """All links of one pivot's block pair whose first shared pivot it is: counts, and edges that connect them."""
        pivot, low, high = (int(k) for k in key)
        rows = rows.sort_values("rep", kind="stable")
        reps, counts, side = rows["rep"].to_numpy(), rows["n"].to_numpy(), rows["side"].to_numpy()
        near = np.stack(rows["near"].to_numpy())
        own = (near == pivot).argmax(axis=1)
        unit = _unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        links, edges = np.zeros(len(rows), dtype=np.int64), set()
        for other, held, place in _later(near, pivot) if shared > 1 else [(pivot, np.arange(len(rows)), own)]:
            first, second = (np.arange(len(held)),) * 2 if low == high else (np.flatnonzero(side[held] == low), np.flatnonzero(side[held] == high))
            a, b = held[first], held[second]
            for i0 in range(0, len(a), 512):
                i = a[i0 : i0 + 512]
                hit = np.abs(own[i][:, None] - own[b]) <= gap
                if shared > 1:
                    hit &= np.abs(place[first[i0 : i0 + 512]][:, None] - place[second]) <= gap
                if low == high:
                    hit &= i[:, None] < b[None, :]
                if hit.any():
                    hit &= unit[i] @ unit[b].T >= threshold
                x, y = np.nonzero(hit)
                if not len(x):
                    continue
                u, v = i[x], b[y]
                row, col = _components(hit)
                edges |= set(zip(reps[i].tolist(), reps[i[row]].tolist()))
                edges |= set(zip(reps[b[np.unique(y)]].tolist(), reps[i[col[np.unique(y)]]].tolist()))
                once = np.ones(len(u), dtype=bool)
                for j in range(0, len(u), 16384):  # a pair counts under its first two shared pivots only
                    p, q = near[u[j : j + 16384]], near[v[j : j + 16384]]
                    before = (p < other) & (p != pivot) if shared > 1 else p < pivot
                    once[j : j + 16384] = ~(shared_places(p, q, gap) & before).any(axis=1)
                np.add.at(links, u[once], counts[v[once]])
                np.add.at(links, v[once], counts[u[once]])
        got = np.flatnonzero(links)
        edge = sorted(e for e in edges if e[0] != e[1])
        return pd.DataFrame({"a": [*reps[got].tolist(), *(e[0] for e in edge)], "b": [*reps[got].tolist(), *(e[1] for e in edge)], "n": [*links[got].tolist(), *(0 for _ in edge)]})

    return run


def _later(near: np.ndarray, pivot: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each pivot after the given one that two rows or more hold, with those rows and its place in each."""
    flat = near.ravel()
    kept = np.flatnonzero(flat > pivot)
    kept = kept[np.argsort(flat[kept], kind="stable")]
    for part in np.split(kept, np.flatnonzero(np.diff(flat[kept])) + 1):
        if len(part) > 1:
            yield int(flat[part[0]]), part // near.shape[1], part % near.shape[1]


def _components(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of hit the smallest row that its true cells reach."""
    n, m = hit.shape
    row, col = np.arange(n), np.full(m, n)
    while True:
        new_col = np.minimum(col, np.where(hit, row[:, None], n).min(axis=0))
        new_row = np.minimum(row, np.where(hit, new_col[None, :], n).min(axis=1))
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with
    nothing and are their own component. Vectors of unlike length are compared within their
    length. A row's links count other rows, so equal vectors link with one another. A null id
    counts as no id for the smallest of a component. Vectors are told apart by all components.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    exact = dict(vectors.select(vector_col).dtypes)[vector_col] == "array<float>"  # floats are doubles, in half the bytes
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if exact else "array<double>").alias("embedding"))
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = materialise(rows.withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("block", F.spark_partition_id()), "pivot-rows")
    distinct = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("low_id"), F.count(F.lit(1)).alias("n"))
    entries = materialise(distinct.select(F.monotonically_increasing_id().alias("rep"), "low_id", "n", "embedding"), "pivot-entries")
    sizes = {r["d"]: r["count"] for r in entries.groupBy(F.size("embedding").alias("d")).count().collect()}
    found = spark.createDataFrame([], "a bigint, b bigint, n bigint")
    for width, count in sorted(sizes.items()):
        found = found.unionByName(_links(entries.where(F.size("embedding") == width), count, threshold, shared, block))
    found = materialise(found, "pivot-links")
    nodes = connected_components(found.where("n = 0").select("a", "b"), "pivot-components")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
    rooted = entries.join(nodes, entries["rep"] == nodes["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    lows = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    digest = materialise(
        rooted.join(lows, "root").join(counts, rooted["rep"] == counts["a"], "left").select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "pivot-digest"
    )
    linked = join_spread(rows.where("ok"), digest, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(entries: DataFrame, n: int, threshold: float, shared: int, block: int) -> DataFrame:
    spark = entries.sparkSession
    count = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n // PER_PIVOT)))
    sample = entries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(2 * count + FITTED).toPandas()["embedding"]
    unit = _unit(np.stack(sample.to_numpy()).astype(np.float64))
    mean = unit.mean(axis=0) if len(unit) >= LEAST_PIVOTS else None
    table = PivotTable(spread_pivots(unit[: 2 * count] if mean is None else _less(unit[: 2 * count], mean), count), mean=mean)
    table.fit(unit[-FITTED:], threshold, shared)
    kind = dict(entries.dtypes)["embedding"]
    lists = materialise(entries.select("rep", "n", "embedding").mapInArrow(_lists(spark.sparkContext.broadcast(table)), f"pivot int, rep bigint, n bigint, near array<int>, embedding {kind}").where("pivot >= 0"), "pivot-lists")
    long = lists.groupBy("pivot").count().where(F.col("count") > block).select("pivot", F.ceil(F.col("count") / block).cast("int").alias("m"))
    # one row a pivot at most, so the broadcast has MOST_PIVOTS rows at most
    own = lists.join(F.broadcast(long), "pivot", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least(o, F.col("side")).cast("int").alias("lo"), F.greatest(o, F.col("side")).cast("int").alias("hi")))
    dealt = own.withColumn("pair", F.explode(pairs)).select("pivot", "pair.lo", "pair.hi", "side", "rep", "n", "near", "embedding")
    return dealt.groupBy("pivot", "lo", "hi").applyInPandas(_compare(table.shared, table.gap, threshold), "a bigint, b bigint, n bigint")


ORACLE = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS node, vec_id AS found FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.found),
    roots AS (SELECT node, min(found) AS root FROM reach GROUP BY node),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
    FROM embeddings LEFT JOIN roots ON node = vec_id LEFT JOIN counts ON a = vec_id
"""
