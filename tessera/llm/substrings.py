"""Repeated passages by fixed-block anchors.

A repeat is a run of WINDOW words that starts at two places or more, of one document or of two.
Every such run holds a whole block of BLOCK = (WINDOW + 1) / 2 words at a multiple of BLOCK, so
that indexing these non-overlapping reference blocks alone is enough to find it:

1. Documents are written once as shards: their words as numbers under a dictionary of the shard.
2. Anchors: every rolling window of BLOCK words of a shard is hashed, and one compressed row of
   sorted distinct hashes goes to each owner of a hash range, with a bit for those that are
   reference blocks. The owner looks all windows up in its reference blocks and answers each
   shard with a bitmap of the hits: windows that also stand elsewhere, and are a block somewhere.
3. Extension: a hit is extended to both sides by all runs of WINDOW words around it. Their hashes
   go to owners the same way, which tell those that more than one place holds. Overlapping
   repeated runs join to maximal exact repeats, whose words go.

A hash met twice within a shard is marked by the shard, so a passage of a third of all documents
costs an owner one hash a shard, and places never meet as pairs. Hits may be false by chance
(the bits of step 2 grow with the corpus, to about one in a thousand); the runs of step 3 have
104-bit hashes, which makes one false repeat in 10**13 words a matter of one in 10**5.

A shard's row to an owner holds about SHARD_WORDS * OWNER_HASHES / (words of the corpus) hashes; both
sizes are parameters, to be raised with the executors' memory (a task needs some 60 bytes a word
of a shard, an owner some 60 bytes a hash) where that falls below ten.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import as_bytes, materialise, shuffle_partitions, text_groups, text_parts
from tessera.llm.packed import flags, pack, unflags, unpack

WINDOW = 35
SHARD_WORDS = 1 << 21
OWNER_HASHES = 1 << 22
#: Bits of an anchor's hash beyond those that number the words of the corpus.
_SPARE_BITS = 10
_EXTRA_BITS = 40

_SHARDS = "shard bigint, n bigint, ids array<bigint>, counts array<bigint>, words binary, codes binary"
_SENT = "owner bigint, shard bigint, n bigint, first binary, gaps binary, extra binary, twice binary, anchor binary"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _write_shards(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        ids, counts, codes, held = [], [], [], 0
        book: dict[bytes, int] = defaultdict(lambda: len(book))

        def row() -> pa.RecordBatch:
            # the most frequent words get the smallest numbers, which pack best
            whole, names = np.concatenate(codes).astype(np.int64), list(book)
            order = np.argsort(-np.bincount(whole, minlength=len(names)), kind="stable")
            number = np.empty(len(names), np.int64)
            number[order] = np.arange(len(names))
            words = zstandard.ZstdCompressor().compress(b" ".join([names[k] for k in order.tolist()]))
            columns = [pa.array([v], t) for v, t in zip((made, held, ids, counts, words, pack(number[whole])), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "n", "ids", "counts", "words", "codes"])

        for batch in text_groups(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))):
                parts = [np.fromiter(map(book.__getitem__, part.split()), np.uint32) for part in text_parts(text)]
                ids.append(doc_id)
                counts.append(sum(map(len, parts)))
                codes += parts
                held += counts[-1]
                if held >= shard_words:
                    yield row()
                    made, ids, counts, codes, held = made + 1, [], [], [], 0
                    book.clear()
        if ids:
            codes.append(np.zeros(0, np.uint32))
            yield row()

    return run


def shards_of(docs: DataFrame, id_col: str, text_col: str, shard_words: int) -> DataFrame:
    """The documents as shards, a table: ids and word counts of the documents, distinct words, and a number for each word."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return materialise(rows.mapInArrow(_write_shards(shard_words), _SHARDS), "substring-shards")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, in their order."""
    x = a * _M1 + (b ^ (b >> np.uint64(29))) * _M3
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of width consecutive words, put together from runs of powers of two."""
    out, done, level, span = None, 0, words, 1
    while True:
        if width & span:
            n = max(0, len(words) - done - span + 1)
            out = level if out is None else _mix(out[:n], level[done : done + n])
            done += span
        if done == width:
            return out
        n = max(0, len(level) - span)
        level = _mix(level[:n], level[span : span + n])
        span *= 2


class Shard:
    """A shard's words as hashes, and which starts of a run lie within one document."""

    def __init__(self, row: dict, window: int):
        from xxhash import xxh64_intdigest

        self.window, self.block = window, (window + 1) // 2
        self.book = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
        self.codes = unpack(row["codes"]).astype(np.int64)
        self.counts = np.array(row["counts"], np.int64)
        self.hashes = np.array([xxh64_intdigest(w) for w in self.book], np.uint64)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.left = np.repeat(self.starts + self.counts, self.counts) - np.arange(len(self.codes))

    def anchors(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows of a block's length, their hashes, and whether each is a reference block."""
        at = np.flatnonzero(self.left >= self.block)
        place = at - np.repeat(self.starts, self.counts)[at]
        return at, rolling(self.hashes, self.block)[at] >> np.uint64(64 - bits), place % self.block == 0

    def runs(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the runs of a whole window that hold a hit, given the starts of the hits."""
        marked = np.zeros(len(self.codes) + self.window + 1, np.int64)
        marked[hit + 1] = 1
        upto = np.cumsum(marked)
        at = np.flatnonzero(self.left >= self.window)
        return at[upto[at + self.window - self.block + 1] > upto[at]]

    def run_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        other = rolling(_mix(self.hashes, np.full(len(self.hashes), _M2)), self.window)[at] >> np.uint64(64 - _EXTRA_BITS)
        return rolling(self.hashes, self.window)[at], other

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which words lie in a run that begins at one of the starts."""
        edge = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge)[:-1] > 0


def _distinct(keys: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys (and extra), and for each sorted place the number of its distinct key."""
    order = np.argsort(keys, kind="stable") if extra is None else np.lexsort((extra, keys))
    k = keys[order]
    new = k[1:] != k[:-1]
    if extra is not None:
        e = extra[order]
        new |= e[1:] != e[:-1]
    return order, np.concatenate([np.zeros(min(1, len(k)), np.int64), np.cumsum(new)])


def _send(shard: int, keys: np.ndarray, extra: np.ndarray | None, anchor: np.ndarray | None, bits: int, owners: int) -> Iterator[tuple]:
    """A shard's distinct hashes as one row for each owner of a hash range that has any."""
    if not len(keys):
        return
    order, number = _distinct(keys, extra)
    lead = np.concatenate([[True], number[1:] != number[:-1]])
    own, held = keys[order][lead], np.bincount(number)
    second = extra[order][lead] if extra is not None else None
    block = np.bincount(number, weights=anchor[order]) > 0 if anchor is not None else np.ones(len(own), bool)
    owner = ((own >> np.uint64(bits - 32)) * np.uint64(owners)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(own))):
        gaps = np.diff(own[lo:hi], prepend=own[lo])
        yield int(owner[lo]), shard, int(hi - lo), int(own[lo]).to_bytes(8, "big"), pack(gaps), pack(second[lo:hi]) if second is not None else b"", flags(held[lo:hi] > 1), flags(block[lo:hi])


def _batches(rows: Iterator[tuple], size: int = 64) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SENT.split(", ")]
    types = [pa.int64()] * 3 + [pa.binary()] * 5
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of all batches, one at a time: a shard's row is large."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One owner's answer: for each shard's row a bitmap of the hashes that stand at two places or more, one of them a reference block."""
    keys = np.concatenate([np.cumsum(unpack(g)) + np.uint64(int.from_bytes(f, "big")) for f, g in zip(rows["first"], rows["gaps"])])
    extra = np.concatenate([unpack(e) for e in rows["extra"]]) if len(rows["extra"].iloc[0]) else None
    twice, anchor = (np.concatenate([unflags(c, n) for c, n in zip(rows[name], rows["n"])]) for name in ("twice", "anchor"))
    order, number = _distinct(keys, extra)
    places = np.bincount(number, weights=1 + twice[order])
    hit = (places > 1) & (np.bincount(number, weights=anchor[order]) > 0)
    back = np.empty(len(keys), bool)
    back[order] = hit[number]
    maps = [flags(x) for x in np.split(back, np.cumsum(rows["n"])[:-1])]
    return pd.DataFrame({"shard": rows["shard"].to_numpy(), "owner": rows["owner"].to_numpy(), "n": rows["n"].to_numpy(), "bitmap": maps})


def _exchange(sent: DataFrame, owners: int, name: str) -> DataFrame:
    """What the owners answer, as a table of one row for each shard: its bitmaps in the owners' order, as a column of that name."""
    answers = sent.repartition(owners, "owner").groupBy("owner").applyInPandas(_answer, "shard bigint, owner bigint, n bigint, bitmap binary")
    return materialise(answers.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("owner", "n", "bitmap"))).alias(name)), f"substring-{name}")


def _marked(keys: np.ndarray, extra: np.ndarray | None, answer: list[dict] | None) -> np.ndarray:
    """Which of a shard's hashes its owners' bitmaps mark."""
    order, number = _distinct(keys, extra)
    out = np.zeros(len(keys), bool)
    if answer:
        out[order] = np.concatenate([unflags(a["bitmap"], a["n"]) for a in answer])[number]
    return out


def _probes(window: int, bits: int, owners: int):
    def rows(batches):
        for row in _rows(batches):
            _, keys, anchor = Shard(row, window).anchors(bits)
            yield from _send(row["shard"], keys, None, anchor, bits, owners)

    return lambda batches: _batches(rows(batches))


def _candidate_runs(row: dict, window: int, bits: int) -> tuple[Shard, np.ndarray, np.ndarray, np.ndarray]:
    shard = Shard(row, window)
    at, keys, _ = shard.anchors(bits)
    starts = shard.runs(at[_marked(keys, None, row["hits"])])
    return shard, starts, *shard.run_hashes(starts)


def _extensions(window: int, bits: int, owners: int):
    def rows(batches):
        for row in _rows(batches):
            _, _, keys, extra = _candidate_runs(row, window, bits)
            yield from _send(row["shard"], keys, extra, None, 64, owners)

    return lambda batches: _batches(rows(batches))


def _kept(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard, starts, keys, extra = _candidate_runs(row, window, bits)
            gone = shard.covered(starts[_marked(keys, extra, row["repeats"])])
            held, size = [], 0
            for doc_id, begin, count in zip(row["ids"], shard.starts.tolist(), shard.counts.tolist()):
                lost = gone[begin : begin + count]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], lost, [0]]).astype(np.int8)))
                text = b" ".join(map(shard.book.__getitem__, shard.codes[begin : begin + count][~lost].tolist()))
                held.append((doc_id, count, [{"start": a, "stop": b} for a, b in edges.reshape(-1, 2).tolist()], text.decode()))
                size += len(text)
                if size > 4_000_000:
                    yield _kept_batch(held)
                    held, size = [], 0
            if held:
                yield _kept_batch(held)

    return run


def _kept_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "n_words", "spans", "kept"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, owner_hashes: int = OWNER_HASHES, owners: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (the words that go, from start to before stop, by place), kept (the text without them).

    Words are what blanks (ASCII space, tab to carriage return) part, compared byte by byte; kept
    words are joined by one space. All places of a repeat go, so of rows that repeat a text of a
    window or more no word stays. A null text has no words and an empty kept text; ids may be
    null or repeat, they name rows and are not compared. Texts shorter than a window stay whole,
    long ones are never cut. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    shards = shards_of(docs, id_col, text_col, shard_words)
    words = shards.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    owners = owners or max(shuffle_partitions(spark), -(-words // owner_hashes))
    bits = min(62, max(40, words.bit_length() + _SPARE_BITS))
    hits = _exchange(shards.select("shard", "words", "codes", "counts").mapInArrow(_probes(window, bits, owners), _SENT), owners, "hits")
    probed = shards.join(hits.hint("merge"), "shard", "left")
    repeats = _exchange(probed.select("shard", "words", "codes", "counts", "hits").mapInArrow(_extensions(window, bits, owners), _SENT), owners, "repeats")
    return probed.join(repeats.hint("merge"), "shard", "left").drop("n").mapInArrow(_kept(window, bits), "doc_id bigint, n_words bigint, spans array<struct<start:bigint,stop:bigint>>, kept string")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of remove_repeats."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(docs).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    w AS (SELECT r, unnest(list_transform(range(1, len(words) - 33), lambda i: md5(array_to_string(words[i:i + 34], ' ')))) AS key, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
    k AS (SELECT key FROM w GROUP BY key HAVING count(*) > 1),
    starts AS (SELECT r, i FROM w JOIN k USING (key)),
    p AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
    marked AS (SELECT p.r, p.i, p.word, max(starts.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
               FROM p LEFT JOIN starts ON starts.r = p.r AND starts.i = p.i),
    kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM marked GROUP BY r)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
