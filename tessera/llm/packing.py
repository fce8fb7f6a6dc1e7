"""Retrieval packing: neighbours found by BM25 share a window.

Documents are encoded once and ordered by a min-hash of their id pairs, so near texts meet; a task
cuts its range of that order into shards of bounded tokens, whatever the lengths of its documents,
and a hot group of copies spreads over as many shards as its rows need. Each shard builds an inverted index with BM25 weights over its token ids, by
document counts and a mean length of the whole corpus; a seed asks its own shard's index. A
seed document opens a window; while the window has room, the seed's best unused neighbour
follows. What does not fit is cut, and its rest opens the next window as the new seed. The
rest of a shard's last window is parted into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import discard, materialise, small_batches, text_groups
from tessera.llm.token_files import pack_ids, unpack_ids, with_end
from tessera.llm.tokenize import encoder, release, vocabulary_path

WINDOW = 2048
#: Tokens that a shard holds at most, unless one document alone has more.
SHARD_TOKENS = 1_000_000
#: Shards that a task packs one after another, by the mean.
TASK_SHARDS = 2
#: A term that more than one document in this many holds has a row of weights for all documents of the shard.
HEAVY = 16
#: Size of the hash table that min-hashes read; ids fall in it by their remainder.
_HASHES = 1 << 16

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed = np.random.default_rng(11).permutation(_HASHES).astype(np.uint64)
        for batch in text_groups(batches):
            ids, bounds = with_end(*encoder(path).encode(batch.column("text")), end)
            pair = (mixed[ids[:-1] % _HASHES] * np.uint64(0x9E3779B97F4A7C15) + mixed[ids[1:] % _HASHES] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(17)
            pair = np.append(pair, np.uint64(1 << 47))
            pair[bounds[1:] - 1] = np.uint64(1 << 47)
            route = np.minimum.reduceat(pair, bounds[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(route.astype(np.int64)), pa.array(np.diff(bounds)), pack_ids(ids, bounds)], names=["doc_id", "route", "n", "code"])

    return run


class Statistics(NamedTuple):
    """What BM25 needs of a whole corpus: its documents, their mean length, and for each term the documents that hold it."""

    n: int
    mean: float
    df: np.ndarray


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(0, np.int64)
    for batch in batches:
        docs = unpack_ids(batch.column("code").to_pylist(), batch.column("n").to_pylist())
        if not docs:
            continue
        terms = np.concatenate(docs).astype(np.int64)
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        found = np.bincount(np.unique(terms * len(docs) + owner) // len(docs), minlength=len(df))
        found[: len(df)] += df
        df = found
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])


def corpus_statistics(coded: DataFrame) -> tuple[int, Statistics]:
    """The tokens of all documents, and their statistics; the driver gets a row for each term of the vocabulary at most."""
    size = coded.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    with small_batches(coded.sparkSession):
        rows = coded.select("n", "code").mapInArrow(_count_terms, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(int(rows["term"].max()) + 1 if len(rows) else 0, np.int64)
    df[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return int(size["tokens"]), Statistics(int(size["docs"]), size["tokens"] / max(1, size["docs"]), df)


class ShardIndex:
    """BM25 over the documents of a shard: for each term the documents that hold it and their weights.

    Weights follow the statistics given, those of the whole corpus, or else the shard's own.
    """

    def __init__(self, docs: list[np.ndarray], statistics: Statistics | None = None, k1: float = 1.2, b: float = 0.75):
        n = len(docs)
        size = np.array([len(d) for d in docs], dtype=np.int64)
        owner = np.repeat(np.arange(n, dtype=np.int64), size)
        terms = np.concatenate(docs).astype(np.int64) if n else np.zeros(0, np.int64)
        pairs, tf = np.unique(terms * n + owner, return_counts=True)
        self.n = n
        self.doc = pairs % n if n else pairs
        term = pairs // n if n else pairs
        self.terms, self.first = np.unique(term, return_index=True)
        self.stop = np.append(self.first[1:], len(term))
        df = self.stop - self.first
        whole = statistics or Statistics(n, float(size.mean()) if n else 1.0, np.bincount(self.terms, df).astype(np.int64))
        held = whole.df[self.terms]
        idf = np.log1p((whole.n - held + 0.5) / (held + 0.5))
        norm = k1 * (1 - b + b * size / max(1.0, whole.mean))
        place = np.repeat(np.arange(len(df)), df)
        self.weight = (idf[place] * tf * (k1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        heavy = np.flatnonzero(df * HEAVY > n)
        row = np.full(len(df), -1)
        row[heavy] = np.arange(len(heavy))
        self.rows = np.zeros((len(heavy), n), dtype=np.float32)
        dense = row[place] >= 0
        self.rows[row[place[dense]], self.doc[dense]] = self.weight[dense]
        self.heavy = self._by_document(row[place[dense]], self.doc[dense])
        self.light = self._by_document(place[~dense], self.doc[~dense])

    def _by_document(self, values: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """For each document its values."""
        order = np.argsort(doc, kind="stable")
        return np.split(values[order], np.searchsorted(doc[order], np.arange(1, self.n))) if self.n else []

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all terms of the seed; 0 where none is shared."""
        light = self.light[seed]
        first, size = self.first[light], self.stop[light] - self.first[light]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.rows[self.heavy[seed]].sum(axis=0) + np.bincount(self.doc[at], self.weight[at], minlength=self.n)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents that share a term with the seed, best first; ties by position."""
        score = np.where(unused, self.scores(seed), 0)
        held = np.flatnonzero(score)
        return held[np.lexsort((held, -score[held]))]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every document once."""
    index = ShardIndex(docs, statistics)
    unused = np.ones(len(docs), dtype=bool)
    sequence = offset = cursor = 0
    seed, score = -1, None
    pieces: list[tuple[int, int, int, int, int]] = []
    while True:
        follower = -1
        if offset and seed >= 0:
            if score is None:
                score = np.where(unused, index.scores(seed), 0)
            best = int(score.argmax())  # the first of the best, so ties go by position
            follower = best if score[best] > 0 else -1
        if follower < 0:
            while cursor < len(docs) and not unused[cursor]:
                cursor += 1
            if cursor == len(docs):
                break
            follower = cursor
            seed, score = follower, None
        unused[follower] = False
        if score is not None:
            score[follower] = 0
        start, left = 0, len(docs[follower])
        while left:
            take = min(left, window - offset)
            pieces.append((follower, start, take, sequence, offset))
            start, left, offset = start + take, left - take, offset + take
            if offset == window:
                sequence, offset = sequence + 1, 0
                seed, score = follower, None
    keep = [p for p in pieces if p[3] < sequence]
    tail = [p for p in pieces if p[3] == sequence]
    yield from keep
    room, filled = _largest_power(offset), 0
    for doc, start, length, _, _ in tail:
        while length:
            take = min(length, room - filled)
            yield doc, start, take, sequence, filled
            start, length, filled, offset = start + take, length - take, filled + take, offset - take
            if filled == room:
                sequence, room, filled = sequence + 1, _largest_power(offset), 0


def _largest_power(n: int) -> int:
    return 1 << (n.bit_length() - 1) if n else 0


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Document ids and token ids of one shard after another: as many rows as have `most` tokens together, one at least."""
    ids, docs, held = [], [], 0
    for batch in batches:
        for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), unpack_ids(batch.column("code").to_pylist(), batch.column("n").to_pylist())):
            if docs and held + len(tokens) > most:
                yield ids, docs
                ids, docs, held = [], [], 0
            ids.append(doc_id)
            docs.append(tokens)
            held += len(tokens)
    if docs:
        yield ids, docs


def _pack(window: int, statistics: Statistics, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        base = TaskContext.get().partitionId() << 32
        for ids, docs in shards(batches, most):
            columns: list[list] = [[] for _ in range(7)]
            for doc, start, length, sequence, offset in pack_shard(docs, window, statistics):
                crc = zlib.crc32(docs[doc][start : start + length].astype("<u4"))
                for column, value in zip(columns, (ids[doc], start, length, crc, len(docs[doc]), base + sequence, offset)):
                    column.append(value)
            base = columns[5][-1] + 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield from pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names).to_batches(max_chunksize=10_000)

    return run


def retrieval_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and is packed as its end id alone. Null and repeated ids are
    kept, each row being a document of its own. A document longer than a window is cut. Every
    sequence is full or a power of two long. Ties of neighbours go by the order of the shard
    (min-hash, id, ids). Other columns are ignored, whatever their names. An empty table gives
    no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = materialise(rows.mapInArrow(_encode(vocabulary or vocabulary_path(), end_id), "doc_id bigint, route bigint, n bigint, code binary"), "pack-ids")
    tokens, statistics = corpus_statistics(coded)
    tasks = max(1, -(-tokens // (TASK_SHARDS * shard_tokens)))
    dealt = coded.repartitionByRange(tasks, "route", "doc_id").sortWithinPartitions("route", "doc_id", "code")
    pieces = materialise(dealt.mapInArrow(_pack(window, statistics, shard_tokens), PIECES), "pack-pieces")
    discard(coded)
    return pieces
