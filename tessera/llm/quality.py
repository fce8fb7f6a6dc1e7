"""Quality scores by Bradley-Terry pairwise ranking.

A labelled good document is preferred to a labelled bad one. Pairs of them, drawn in hash
order, give a logistic loss on differences of features, so the weights rank documents. The
ranking becomes a score from 0 to 1 whose threshold is a quantile: the raw score that parts the
training documents as their labels do (by balanced accuracy over score quantiles) lies at 0.7.

Features are shares over whole texts: letters, digits, spaces, marks, capitals, words that end
in marks, repeated words and repeated word pairs, lengths of words and lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import as_bytes, materialise, small_batches, text_groups

#: Labelled documents that the ranking is fitted on at most, half of them of each label, and the
#: preference pairs drawn among them: documented bounds of what is learned from.
MOST_LABELLED = 20_000
PAIRS = 200_000
THRESHOLD = 0.7

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123] = 1  # a-z
_CLASS[65:91] = 2  # A-Z
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:'\"?"]] = 6
_CLASS[[ord(c) for c in "|"]] = 7
_CLASS[[ord(c) for c in "!"]] = 8
_CLASS[[ord(c) for c in "#$%&*@^~+=<>\\_{}[]"]] = 9
N_FEATURES = 26


def features(text: bytes) -> np.ndarray:
    """The features of one whole text; an empty text's are zero but for a flag."""
    out = np.zeros(N_FEATURES)
    data = np.frombuffer(text, dtype=np.uint8)
    words = text.split()
    if not words:
        out[0] = 1
        return out
    kind = _CLASS[data]
    out[1:11] = np.bincount(kind, minlength=10)[:10] / len(data)
    n = len(words)
    distinct = len(set(words))
    lines = text.split(b"\n")
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), dtype=np.uint8)
    size = np.array([len(w) for w in words])
    pairs = len(set(pairwise(words)))
    out[11] = distinct / n
    out[12] = pairs / max(1, n - 1)
    out[13] = (_CLASS[ends] == 9).mean()
    out[14] = (_CLASS[ends] == 8).mean()
    out[15] = (_CLASS[ends] == 7).mean()
    out[16] = np.log1p(n)
    out[17] = size.mean() / 10
    out[18] = size.std() / 10
    out[19] = len(set(lines)) / len(lines)
    out[20] = np.log1p(len(data) / len(lines)) / 10
    out[21] = distinct / n**0.8
    out[22] = max(out[13], out[14], out[15])
    out[23] = _most_in_a_row(words) / n
    out[24] = float(out[13] > 0.05) + float(out[14] > 0.05) + float(out[15] > 0.05)
    out[25] = (out[2] > 0.15) * 1.0
    return out


def _most_in_a_row(words: list[bytes]) -> int:
    """The length of the longest run of one word."""
    best = run = 1
    for a, b in pairwise(words):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return best


class BradleyTerry:
    """Weights on standardised features and the line that maps raw scores to 0 to 1."""

    def __init__(self, x: np.ndarray, label: np.ndarray, ridge: float = 1e-3, pairs: int = PAIRS, seed: int = 5):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - self.mean) / self.scale
        good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
        self.weight, self.at, self.slope = np.zeros(z.shape[1]), 0.0, 1.0
        if not len(good) or not len(bad):  # one label only: every document scores alike, on that label's side
            self.at = -np.inf if len(good) else np.inf
            return
        rng = np.random.default_rng(seed)
        n = min(pairs, len(good) * len(bad))
        diff = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
        for _ in range(50):  # Newton steps on the mean logistic loss
            p = 1 / (1 + np.exp(np.clip(diff @ self.weight, -30, 30)))
            grad = -(diff * p[:, None]).mean(axis=0) + ridge * self.weight
            hess = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(grad))
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
            self.weight -= step
            if np.abs(step).max() < 1e-6:
                break
        raw = z @ self.weight
        cuts = np.unique(np.quantile(raw, np.linspace(0, 1, 1001)))
        cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
        share = [((raw[good] >= c).mean() + (raw[bad] < c).mean()) for c in cuts]
        best = np.flatnonzero(np.array(share) >= max(share) - 1e-12)
        self.at = float(np.median(cuts[best]))
        self.slope = 2.0 / (np.quantile(np.abs(raw - self.at), 0.5) + 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; THRESHOLD where the raw score is the chosen quantile."""
        raw = ((x - self.mean) / self.scale) @ self.weight - self.at
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_groups(batches):
        rows = [features(t) for t in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["label", "x"])


def _score(model: BradleyTerry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches):
            x = np.stack([features(t) for t in as_bytes(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def held_out(doc_id):
    """True where the remainder is 2 of the id's checksum, whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label of at most `most` labelled documents that are not held out, half of each label, in hash order.

    Rows whose id or label is null teach nothing; an id that is labelled twice counts as its larger label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("label").alias("label"))
    halves = [known.where(F.col("label") == v).orderBy(F.xxhash64("_id"), "_id").limit(most // 2) for v in (0, 1)]
    picked = materialise(halves[0].unionByName(halves[1]), "training-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(picked), rows["_doc"] == picked["_id"]).select("_id", "text", "label")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS) -> BradleyTerry:
    """Fit on labels.quality by `pairs` preference pairs; the features of at most `most` documents reach the driver."""
    with small_batches(docs.sparkSession):
        rows = training_rows(docs, labels, "quality", most, id_col, text_col).select("label", "text").mapInArrow(_extract, "label int, x array<double>").toPandas()
    if not len(rows):
        return BradleyTerry(np.zeros((1, N_FEATURES)), np.array([1]), pairs=pairs)
    order = np.lexsort(np.stack(rows["x"].to_numpy()).T)
    return BradleyTerry(np.stack(rows["x"].to_numpy())[order], rows["label"].to_numpy()[order], pairs=pairs)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, pairs: int = PAIRS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null, empty and blank texts are scored by a flag of their own. Null ids are not held out.
    Without usable labels of both kinds every score is 1 (or 0 where only bad ones exist). An
    empty table gives no rows.
    """
    model = fit_quality(docs, labels, most, id_col, text_col, pairs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = materialise(rows.mapInArrow(_score(model), "doc_id bigint, score double"), "quality-scores")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, pairs: int = PAIRS) -> DataFrame:
    """docs that the classifier does not reject; columns, whatever their names, and kept rows are unchanged.

    Every row is judged by its own text alone, a null one as an empty one; null and repeated ids,
    ties and repeated rows change nothing. Without usable labels of both kinds all stay (or all
    go where only bad ones exist). An empty table stays empty.
    """
    model = fit_quality(docs, labels, most, id_col, text_col, pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches, text_col):
            texts = [t or b"" for t in as_bytes(batch.column(batch.schema.get_field_index(text_col)))]
            score = model.score(np.stack([features(t) for t in texts]))
            yield batch.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
