"""Toxicity scores by a support vector machine over a subsequence string kernel.

The kernel compares short units (words, and runs of single letters taken together) by their
common subsequences of four symbols inside a window of six, weighed by decay to the power of
the span; so an insult with gaps or inserted characters stays close to the plain one. Nyström
landmarks, units of the training texts, span the feature space. Since every landmark is a sum
of subsequences, the trained machine folds into one table of subsequence weights, and a unit is
scored by looking its own subsequences up: the sum over landmarks without comparing with each.

Labels are of documents; a toxic document's most telling unit stands for it. Units are first
weighed by the toxic and clean training documents that hold them, or hold four of their letters;
clean units weigh more the more clean documents hold them. Of the most telling units, variants with
a letter inserted, doubled or dropped are learned too, but for those that clean documents hold. A
document's score is a logistic function of its highest unit score, fitted on the training
documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import materialise, small_batches, text_groups
from tessera.llm.quality import held_out, training_rows

#: Documented bounds of what is learned from: labelled documents, characters of a unit, units of each
#: kind that reach the driver, disguised variants of them, landmarks. Scoring has none of them.
MOST_LABELLED = 16_000
MOST_LENGTH = 64
MOST_UNITS = 4_000
MOST_DISGUISED = 1_000
LANDMARKS = 256
THRESHOLD = 0.3

#: Least log likelihood gain for a unit, or for four letters of it, to tell of toxicity; and that of
#: a unit whose variants are learned.
LEAST_GAIN, SURE_GAIN = 15, 60
#: Trainings, each with the hardest clean units that the one before has left.
ROUNDS = 3

ORDER, WINDOW, DECAY = 4, 6, 0.75
_SYMBOLS = 32
_GAPS = [(0, *c) for c in combinations(range(1, WINDOW), ORDER - 1)]
_EDGE = 31

#: Letters have a symbol each and digits that stand for letters share theirs; 0 is left out of a unit.
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
for _digit, _letter in zip(b"0134578@$", b"oieastbas"):
    _SYMBOL[_digit] = _SYMBOL[_letter]
_SYMBOL[[ord("2"), ord("6"), ord("9")]] = 27
_SYMBOL[128:192] = 28 + np.arange(64) % 3


def _codes(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all units in one array, each unit between edges, and where each unit begins and ends."""
    units = units.cast(pa.large_binary())
    bounds = units.buffers()[1]
    offsets = np.frombuffer(bounds, dtype=np.int64)[units.offset : units.offset + len(units) + 1]
    data = np.frombuffer(units.buffers()[2], dtype=np.uint8) if units.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    symbols = _SYMBOL[data]
    kept = symbols > 0
    before = np.append(0, np.cumsum(kept))[offsets]
    full = np.insert(symbols[kept], np.repeat(before, 1)[:-1], _EDGE) if len(units) else symbols[kept]
    starts = before[:-1] + np.arange(len(units))
    full = np.insert(full, np.append(starts[1:], len(full)), _EDGE)
    ends = before + 2 * np.arange(len(units) + 1)
    return full, ends


def _subsequences(units: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: the unit, the subsequence's number, and its weight."""
    codes, ends = _codes(units)
    owner = np.repeat(np.arange(len(units)), np.diff(ends))
    last = ends[1:][owner] if len(owner) else owner
    at = np.arange(len(codes))
    for gaps in _GAPS:
        ok = np.flatnonzero(at + gaps[-1] < last)
        number = codes[ok]
        for g in gaps[1:]:
            number = number * _SYMBOLS + codes[ok + g]
        yield owner[ok], number, DECAY ** (gaps[-1] + 1)


class Subsequences:
    """All subsequences of a column of units, found once, and each unit's norm."""

    def __init__(self, units: pa.Array):
        self.n = len(units)
        parts = [(owner, number, np.full(len(owner), weight)) for owner, number, weight in _subsequences(units)]
        self.owner, self.number, self.weight = (np.concatenate(x) for x in zip(*parts))
        self.norm = np.sqrt(np.maximum(np.bincount(self.owner, self.weight**2, minlength=self.n), 1e-12))

    def scores(self, table: np.ndarray) -> np.ndarray:
        """A folded machine's value of each unit: its subsequences' weights over the unit's own norm."""
        return np.bincount(self.owner, table[self.number] * self.weight, minlength=self.n) / self.norm

    def fold(self, alpha: np.ndarray) -> np.ndarray:
        """The table of a weighted sum of these units, each of norm one."""
        return np.bincount(self.number, (alpha / self.norm)[self.owner] * self.weight, minlength=_SYMBOLS**ORDER).astype(np.float32)


def unit_scores(units: pa.Array, table: np.ndarray) -> np.ndarray:
    """The folded machine's value of each unit."""
    return Subsequences(units).scores(table)


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """The kernel of each unit of a with each of b: the decayed subsequences they share, over both norms."""
    left = Subsequences(pa.array(a, pa.large_string()))
    return np.stack([left.scores(Subsequences(pa.array([u], pa.large_string())).fold(np.ones(1))) for u in b], axis=1)


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of a column of texts, each text's units in turn by number, and their bounds."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64) if len(coded) else np.zeros(0, np.int64)
    words = coded.dictionary
    # runs of three or more single characters within a text become a unit of their own
    single = (pc.utf8_length(words).to_numpy() == 1)[place] if len(place) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    joined, whose = [], []
    cuts = set(bounds.tolist())
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a < 3:
            continue
        inner = [a, *(c for c in range(a + 1, b) if c in cuts), b]
        for lo, hi in zip(inner[:-1], inner[1:]):
            if hi - lo >= 3:
                joined.append("".join(flat[lo:hi].to_pylist()))
                whose.append(owner[lo])
    if joined:
        words = pa.concat_arrays([words, pa.array(joined, words.type)])
        place = np.append(place, np.arange(len(coded.dictionary), len(words)))
        owner = np.append(owner, whose)
        order = np.argsort(owner, kind="stable")
        place = place[order]
        bounds = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return words, place, bounds


def _highest(values: np.ndarray, bounds: np.ndarray, floor: float = -1.0) -> np.ndarray:
    """The highest value of each text, not below floor; texts without units have the floor."""
    out = np.full(len(bounds) - 1, floor)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.maximum.reduceat(values, bounds[full])
    return np.maximum(out, floor)


def _doc_scores(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    words, place, bounds = units_of(texts)
    return _highest(unit_scores(words, table)[place] if len(place) else np.zeros(0), bounds)


class KernelMachine:
    """The Nyström support vector machine, folded into a table of subsequence weights."""

    def __init__(self, units: list[str], label: np.ndarray, weight: np.ndarray, landmarks: int = LANDMARKS, cost: float = 4.0):
        self.table = np.zeros(_SYMBOLS**ORDER, dtype=np.float32)
        good, bad = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
        if not len(good) or not len(bad):
            return
        column = pa.array(units, pa.large_string())
        known = Subsequences(column)
        order = np.concatenate([bad[np.argsort(-weight[bad], kind="stable")], good])
        most, chosen, columns, near = {1: 2 * landmarks // 3, 0: landmarks // 3}, [], [], np.zeros(len(units))
        for i in order:  # landmarks unlike one another
            if near[i] < 0.6 and most[label[i]]:
                most[label[i]] -= 1
                chosen.append(i)
                columns.append(known.scores(Subsequences(column.take(pa.array([i]))).fold(np.ones(1))))
                near = np.maximum(near, columns[-1])
        shared = np.stack(columns, axis=1)
        values, vectors = np.linalg.eigh(shared[chosen])
        held = values > 1e-6 * values[-1]
        root = vectors[:, held] / np.sqrt(values[held])
        x = np.hstack([shared @ root, np.ones((len(units), 1))])
        y = np.where(label == 1, 1.0, -1.0)
        c = cost * weight
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps on the squared hinge loss
            margin = 1 - y * (x @ w)
            on = margin > 0
            grad = w * np.append(np.ones(len(w) - 1), 1e-3) - 2 * (x[on] * (c[on] * y[on] * margin[on])[:, None]).sum(axis=0)
            hess = np.diag(np.append(np.ones(len(w) - 1), 1e-3)) + 2 * (x[on] * c[on][:, None]).T @ x[on]
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.table = Subsequences(column.take(pa.array(chosen))).fold(root @ w[:-1])


def _logistic(x: np.ndarray, label: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - label) / len(x) + ridge * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _held_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_groups(batches):
        words, place, bounds = units_of(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(bounds))
        once = np.unique(owner * max(1, len(words)) + place)
        label = batch.column("label").to_numpy()[once // max(1, len(words))]
        out = pa.RecordBatch.from_arrays([words.take(pa.array(once % max(1, len(words)))).cast(pa.string()), pa.array(label.astype(np.int32))], names=["unit", "label"])
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)


def _score_batches(table: np.ndarray, kept: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches):
            top = _doc_scores(batch.column("text"), table)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(top)], names=[*kept, "top"])

    return run


def disguised(units: list[str], most: int = MOST_DISGUISED, seed: int = 17) -> list[str]:
    """Up to `most` variants of units of four letters or more, those of the first units first, as an author may hide an insult.

    At every inner place a letter is inserted (four variants), doubled, or, from five letters on, dropped.
    """
    rng, out, seen = np.random.default_rng(seed), [], set()
    for unit in units:
        bare = "".join(c for c in unit if c.isalnum())
        if sum(c.isalpha() for c in bare) < 4 or bare in seen:
            continue
        seen.add(bare)
        for at in range(1, len(bare)):
            out += [bare[:at] + chr(97 + int(rng.integers(26))) + bare[at:] for _ in range(4)] + [bare[:at] + bare[at - 1] + bare[at:]]
        if len(bare) >= 5:
            out += [bare[:at] + bare[at + 1 :] for at in range(1, len(bare) - 1)]
        if len(out) >= most:
            break
    return list(dict.fromkeys(out))[:most]


def _score_units(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = unit_scores(batch.column("unit").cast(pa.large_string()), table)
                yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("n0"), pa.array(values)], names=["unit", "n0", "value"])

    return run


def _gain(n1: Column, n0: Column, share: float) -> Column:
    """Log likelihood that toxic texts hold a string more than their share explains; 0 where they hold it less."""
    n = n1 + n0
    gain = F.coalesce(n1 * F.ln(F.when(n1 > 0, n1 / (n * share))), F.lit(0.0)) + F.coalesce(n0 * F.ln(F.when(n0 > 0, n0 / (n * (1 - share)))), F.lit(0.0))
    return F.when((n1 >= 9 * n0) & (n1 > n * share), gain).otherwise(0.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The folded table and the document calibration, from labels.toxic of at most `most` documents."""
    rows = materialise(training_rows(docs, labels, "toxic", most, id_col, text_col).select("label", "text"), "toxic-training")
    counted = rows.mapInArrow(_held_units, "unit string, label int").groupBy("unit").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    counted = materialise(counted.where(F.length("unit") <= MOST_LENGTH), "toxic-units")
    sizes = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in sizes}
    if not n.get(0) or not n.get(1):
        return np.zeros(_SYMBOLS**ORDER, dtype=np.float32), np.array([0.0, 5.0 if n.get(1) else -5.0])
    share = n[1] / (n[0] + n[1])
    own = counted.withColumn("g", _gain(F.col("n1"), F.col("n0"), share))
    grams = own.where(F.length("unit") >= 4).withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("unit") - 3), lambda i: F.substring("unit", i, F.lit(4))))))
    strong = grams.groupBy("gram").agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0")).withColumn("s", _gain(F.col("s1"), F.col("s0"), share)).where(f"s >= {LEAST_GAIN}").select("gram", "s")
    parts = grams.where("n1 > 0 and n1 >= 9 * n0").join(strong, "gram").groupBy("unit").agg(F.max("s").alias("s"))
    told = own.where("n1 > 0 and n1 >= 9 * n0").join(parts, "unit", "left").withColumn("g", F.greatest("g", F.coalesce("s", F.lit(0.0)))).where(f"g >= {LEAST_GAIN}")
    telling = told.orderBy(F.desc("g"), F.desc("n1"), "unit").limit(MOST_UNITS).select("unit", "g").collect()
    innocent = counted.where("n0 > 0 and n1 < 9 * n0").select("unit", "n0")
    plain = innocent.orderBy(F.xxhash64("unit"), "unit").limit(MOST_UNITS).collect()
    common = innocent.orderBy(F.desc("n0"), "unit").limit(MOST_UNITS // 4).collect()
    if not telling:
        return np.zeros(_SYMBOLS**ORDER, dtype=np.float32), np.array([0.0, float(np.log(share / (1 - share)))])
    known = [r["unit"] for r in telling]
    shown = [min(10.0, max(2.0, r["g"] / SURE_GAIN)) for r in telling]
    hidden = disguised([r["unit"] for r in telling if r["g"] >= SURE_GAIN])
    met = innocent.join(F.broadcast(rows.sparkSession.createDataFrame([(u,) for u in hidden], "unit string")), "unit", "left_semi").collect()
    hidden = [u for u in hidden if u not in {r["unit"] for r in met}]
    clean = {r["unit"]: r["n0"] for r in (*plain, *common, *met)}
    for _ in range(ROUNDS):  # clean units that the last machine holds for toxic teach the next one
        units = sorted(clean)
        weight = [*shown, *[0.5] * len(hidden), *[min(10.0, 1 + np.log2(clean[u])) for u in units]]
        machine = KernelMachine([*known, *hidden, *units], np.array([1] * (len(known) + len(hidden)) + [0] * len(units)), np.array(weight))
        scored = innocent.mapInArrow(_score_units(machine.table), "unit string, n0 bigint, value double")
        clean |= {r["unit"]: r["n0"] for r in scored.orderBy(F.desc("value"), "unit").limit(MOST_UNITS // 4).collect()}
    with small_batches(docs.sparkSession):
        seen = rows.mapInArrow(_score_batches(machine.table, ("label",)), "label int, top double").toPandas()
    seen = seen.sort_values(["label", "top"])
    return machine.table, _logistic(seen[["top"]].to_numpy(), seen["label"].to_numpy().astype(float))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null, empty and blank texts have no unit and get the lowest score. Null ids are not held
    out. Without usable labels of both kinds every document scores alike. An empty table
    gives no rows.
    """
    table, line = fit_toxicity(docs, labels, most, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score_batches(shared.value, ("doc_id",))(batches)

    tops = materialise(rows.mapInArrow(run, "doc_id bigint, top double"), "toxicity-tops")
    score = 1 / (1 + F.exp(-(F.lit(float(line[0])) * F.col("top") + F.lit(float(line[1])))))
    return tops.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
