"""Phrases whose words belong together: count tries by shard, merged by prefix range.

1. Documents are written once as shards: pieces of words as numbers under a dictionary of the
   shard, with the words' counts. The dictionaries add up to the corpus's counts of words. Words
   counted less than `least` are in no candidate and no part of one, so only the others get a
   number in the corpus, by falling count; a rarer word ends a piece.
2. A shard's trie of depth four is its sorted run of distinct suffixes (a word and up to three
   that follow it) with counts: a node is a prefix, its count the sum below it. It is serialised
   level by level, each suffix without what it shares with the one before, and cut at the bounds
   of the prefix ranges. The bounds balance the ranges and change no result; they come from a
   sample of at most SAMPLE suffixes, as those of a range partitioner do.
3. The owner of a range merges the sorted runs of all shards and walks the merged trie: a node's
   count, and the counts of its prefixes, the left parts. A node that a bound cuts is
   counted in several ranges; those few (three for a bound) are added up afterwards.
4. A phrase's right parts are behind its suffix link, the phrase without its first word, which
   holds the right parts of the rest in turn: one join for each depth, over phrases of `least`
   occurrences or more alone.
5. Scores, the phrases that longer ones cover, and ranks are DataFrame operations.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import as_bytes, join_spread, materialise, shuffle_partitions, text_groups, text_parts
from tessera.llm.packed import pack, unpack

DEPTH = 4
LEAST = 30
TOP = 2000
#: A longer candidate with so many hundredths of a phrase's occurrences covers it.
COVER = 80
SHARD_WORDS = 1 << 21
OWNER_SUFFIXES = 1 << 21
SAMPLE = 100_000

_STOPS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_SHARDS = "shard bigint, n bigint, langs array<string>, words array<string>, counts array<bigint>, codes binary"
_SENT = "owner bigint, shard bigint, trie binary"
_IDS = [f"w{k}" for k in range(1, DEPTH + 1)]
_NODES = ", ".join(f"{w} bigint" for w in _IDS) + ", depth int, n bigint, l1 bigint, l2 bigint, l3 bigint, cut boolean"


def pieces(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, with a full stop where a piece ends (no word holds one)."""
    return text.lower().translate(_STOPS).replace(b".", b" . ").split()


def _write_shards(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 32, 0
        codes: list[np.ndarray] = []
        last = [0]
        books: dict[str, dict[bytes, int]] = {}

        def number() -> int:
            last[0] += 1
            return last[0]

        def row() -> pa.RecordBatch:
            whole = np.concatenate(codes)
            counts = np.bincount(whole, minlength=last[0] + 1)
            known = [(lang, word, code) for lang, book in books.items() for word, code in book.items() if code]
            known.sort(key=lambda x: x[2])
            langs, words, _ = zip(*known) if known else ((), (), ())
            columns = [pa.array([v], t) for v, t in zip((made, held, list(langs)), (pa.int64(), pa.int64(), pa.list_(pa.string())))]
            columns += [pa.array([list(words)], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([counts[1:].tolist()], pa.list_(pa.int64())), pa.array([pack(whole)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "n", "langs", "words", "counts", "codes"])

        for batch in text_groups(batches):
            for text, lang in zip(as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
                if lang not in books:
                    books[lang] = defaultdict(number, {b".": 0})
                for part in text_parts(text):
                    codes.append(np.fromiter(map(books[lang].__getitem__, pieces(part)), np.uint32))
                    held += len(codes[-1])
                codes.append(np.zeros(1, np.uint32))
            if held >= shard_words:
                yield row()
                made, codes, held, books = made + 1, [], 0, {}
                last[0] = 0
        if codes:
            yield row()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of all batches, one at a time: a shard's row is large."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _sequence(row: dict) -> np.ndarray:
    """A shard's words by their numbers in the corpus, 0 for a rare word or the end of a piece, and zeros at the end."""
    codes = unpack(row["codes"]).astype(np.int64)
    table = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    for known in row["known"] or ():
        table[known["code"]] = known["id"]
    return np.concatenate([table[codes], np.zeros(DEPTH - 1, np.int64)])


def suffixes(sequence: np.ndarray) -> np.ndarray:
    """Each word with up to three that follow it in its piece, padded with zeros, as columns."""
    starts = np.flatnonzero(sequence[: 1 - DEPTH])
    out = np.stack([sequence[starts + k] for k in range(DEPTH)])
    for k in range(1, DEPTH):
        out[k][out[k - 1] == 0] = 0
    return out


def sorted_runs(columns: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes in order, and how often each occurs; runs that are sorted already merge in linear time."""
    if not columns.shape[1]:
        return columns, np.zeros(0, np.int64)
    ids = np.unique(columns)
    bits = max(1, int(len(ids)).bit_length())
    ranks = np.searchsorted(ids, columns).astype(np.uint64)
    words = [ranks[0] << np.uint64(bits) | ranks[1], ranks[2] << np.uint64(bits) | ranks[3]]
    if 4 * bits <= 64:
        order = np.argsort(words[0] << np.uint64(2 * bits) | words[1], kind="stable")
    else:
        order = np.lexsort((words[1], words[0]))
    lead = np.concatenate([[True], (np.diff(words[0][order].view(np.int64)) != 0) | (np.diff(words[1][order].view(np.int64)) != 0)])
    first = np.flatnonzero(lead)
    held = np.diff(np.append(first, len(order))) if counts is None else np.add.reduceat(counts[order], first)
    return columns[:, order[first]], held


def _shared(columns: np.ndarray) -> np.ndarray:
    """How many leading words each suffix shares with the one before it."""
    same = np.cumprod(columns[:, 1:] == columns[:, :-1], axis=0).sum(axis=0)
    return np.concatenate([[0], same]).astype(np.int64)


def write_trie(columns: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run as a trie: the shared depths, each level's new nodes, the counts."""
    shared = _shared(columns)
    parts = [pack(shared), *(pack(columns[k][shared <= k]) for k in range(DEPTH)), pack(counts)]
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


def read_trie(code: bytes) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(code):
        size = int.from_bytes(code[at : at + 4], "big")
        parts.append(unpack(code[at + 4 : at + 4 + size]).astype(np.int64))
        at += 4 + size
    shared = parts[0]
    return np.stack([parts[k + 1][np.cumsum(shared <= k) - 1] for k in range(DEPTH)]), parts[-1]


def _cuts(columns: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the bounds (one in each column) cut a sorted run: the first suffix that is not below each."""
    text = f"S{8 * DEPTH}"
    whole = lambda x: np.ascontiguousarray(x.T.astype(">i8")).view(text).ravel() if x.shape[1] else np.zeros(0, text)
    return np.searchsorted(whole(columns), whole(bounds), side="left")


def _send_tries(bounds: np.ndarray):
    names, types = [c.split()[0] for c in _SENT.split(", ")], (pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            columns, counts = sorted_runs(suffixes(_sequence(row)))
            edges = np.concatenate([[0], _cuts(columns, bounds), [columns.shape[1]]])
            sent = [(k, row["shard"], write_trie(columns[:, a:b], counts[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
            for at in range(0, len(sent), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sent[at : at + 64]), types)], names=names)

    return run


def _merge(bounds: np.ndarray, least: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The nodes of one range: merged runs, walked from the root."""
        owner = int(rows["owner"].iloc[0])
        runs = [read_trie(code) for code in rows["trie"]]
        columns, counts = sorted_runs(np.concatenate([c for c, _ in runs], axis=1), np.concatenate([n for _, n in runs]))
        sides = [bounds[:, k] for k in (owner - 1, owner) if 0 <= k < bounds.shape[1]]
        shared, upto, out = _shared(columns), np.concatenate([[0], np.cumsum(counts)]), []
        above: list[np.ndarray] = []
        for depth in range(1, DEPTH + 1):
            first = np.flatnonzero((shared < depth))
            total = np.diff(upto[np.append(first, columns.shape[1])])
            above.append(np.repeat(total, np.diff(np.append(first, columns.shape[1]))))
            cut = np.zeros(len(first), bool)
            for bound in sides:
                cut |= (columns[:depth, first] == bound[:depth, None]).all(axis=0)
            keep = (columns[depth - 1, first] > 0) & (cut | (total >= least))
            at = first[keep]
            words = np.where(np.arange(DEPTH)[:, None] < depth, columns[:, at], 0)
            frame = dict(zip(_IDS, words)) | {"depth": np.full(len(at), depth, np.int32), "n": total[keep]}
            frame |= {f"l{k}": above[k - 1][at] if k < depth else np.zeros(len(at), np.int64) for k in range(1, DEPTH)}
            out.append(pd.DataFrame(frame | {"cut": cut[keep]}))
        return pd.concat(out)

    return run


def _numbered(words: DataFrame, least: int) -> DataFrame:
    """lang, word, n and id of the words with least occurrences: ids from 1 by falling count, by a range sort and the sizes of its partitions."""
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ordered = materialise(often.orderBy(F.desc("n"), "lang", "word").withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    part, row = F.shiftrightunsigned("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("offset"))
    placed = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    return placed.select("lang", "word", "n", (F.coalesce("offset", F.lit(0)) + row + 1).alias("id"))


def _bounds(shards: DataFrame, words: int, owners: int) -> np.ndarray:
    """Bounds of the prefix ranges, from a sample of at most SAMPLE suffixes, a shard's share by its words."""
    share = min(1.0, SAMPLE / 2 / max(1, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            sequence, draw = _sequence(row), np.random.default_rng(row["shard"])
            columns = suffixes(sequence)
            some = columns[:, draw.random(columns.shape[1]) < share]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in some], names=_IDS)

    drawn = shards.mapInArrow(run, ", ".join(f"{w} bigint" for w in _IDS)).limit(SAMPLE).toPandas().to_numpy(np.int64).T.reshape(DEPTH, -1)
    drawn = drawn[:, np.lexsort(drawn[::-1])]
    at = np.unique(np.linspace(0, drawn.shape[1], owners + 1)[1:-1].astype(np.int64)) if drawn.shape[1] else np.zeros(0, np.int64)
    return np.unique(drawn[:, at], axis=1)


def _phrases(nodes: DataFrame) -> DataFrame:
    """The nodes with whole counts: those that bounds cut are added up, and what lies below them gets the sums as left parts."""
    cut = nodes.where("cut")
    whole = cut.groupBy(*_IDS, "depth").agg(F.sum("n").alias("n"), *[F.sum(f"l{k}").alias(f"l{k}") for k in range(1, DEPTH)])
    merged = nodes.where("not cut").drop("cut").unionByName(whole)
    for k in range(1, DEPTH):
        sums = whole.where(F.col("depth") == k).select(*[F.col(w).alias(f"_{w}") for w in _IDS[:k]], F.col("n").alias("_sum"))
        same = [F.col(w) == F.col(f"_{w}") for w in _IDS[:k]]
        merged = merged.join(F.broadcast(sums), same, "left").withColumn(f"l{k}", F.when(F.col("depth") > k, F.coalesce("_sum", f"l{k}")).otherwise(F.col(f"l{k}"))).drop("_sum", *[f"_{w}" for w in _IDS[:k]])
    return merged


def _with_right_parts(phrases: DataFrame) -> DataFrame:
    """phrases with r1 to r3, the counts of what is left without the first one to three words, through suffix links."""
    key = lambda names: F.struct(*[F.col(w).alias(f"k{k}") for k, w in enumerate(names)])
    linked = phrases.where("depth = 1").select("*", *[F.lit(0).cast("long").alias(f"r{k}") for k in range(1, DEPTH)])
    out = linked
    for depth in range(2, DEPTH + 1):
        behind = linked.select(key(_IDS[: depth - 1]).alias("key"), F.col("n").alias("r1"), *[F.col(f"r{k}").alias(f"r{k + 1}") for k in range(1, DEPTH - 1)])
        rows = phrases.where(F.col("depth") == depth).withColumn("block", F.spark_partition_id()).withColumn("key", key(_IDS[1:depth]))
        linked = materialise(join_spread(materialise(rows, "phrase-rows"), behind, "key").drop("block", "key"), "phrase-links")
        out = out.unionByName(linked)
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * whole(a), whole(left) + whole(right))


def phrase_candidates(docs: DataFrame, text_col: str, lang_col: str, least: int, shard_words: int, owners: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (w1 to w4, depth, a, l, r, score), the numbered words (lang, word, n, id), and all words by language (lang, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    shards = materialise(rows.mapInArrow(_write_shards(shard_words), _SHARDS), "phrase-shards")
    local = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("code", "w"))
    local = local.select("shard", (F.col("code") + 1).cast("long").alias("code"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = materialise(local.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    numbered = materialise(_numbered(local, least), "phrase-numbers")
    known = local.join(numbered.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    coded = materialise(shards.select("shard", "codes").join(known.hint("merge"), "shard"), "phrase-coded")
    words = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    owners = owners or max(shuffle_partitions(spark), -(-words // OWNER_SUFFIXES))
    bounds = _bounds(coded, words, owners)
    sent = coded.mapInArrow(_send_tries(bounds), _SENT).repartition(bounds.shape[1] + 1, "owner")
    nodes = materialise(sent.groupBy("owner").applyInPandas(_merge(bounds, least), _NODES), "phrase-nodes")
    phrases = materialise(_phrases(nodes).where(F.col("n") >= least), "phrases")
    parted = _with_right_parts(phrases).where("depth > 1").withColumnRenamed("n", "a")
    part = lambda k: F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    cuts = [F.when(F.col("depth") > k, part(k)) for k in range(1, DEPTH)]
    scored = parted.select(*_IDS, "depth", "a", F.least(*cuts).alias("cut")).select(*_IDS, "depth", "a", "cut.l", "cut.r", "cut.score")
    return materialise(scored, "phrase-candidates"), numbered, totals


def _uncovered(candidates: DataFrame) -> DataFrame:
    """The candidates that no longer candidate covers."""
    places = [(size, at) for size in range(2, DEPTH) for at in range(DEPTH - size + 1)]
    inner = {(size, at): F.struct(*[F.col(w).alias(_IDS[k]) for k, w in enumerate(_IDS[at : at + size])], *[F.lit(0).cast("long").alias(w) for w in _IDS[size:]]) for size, at in places}
    longer = F.filter(F.array(*[F.when((F.col("depth") > size) & (F.col("depth") >= at + size), inner[size, at]) for size, at in places]), lambda s: s.isNotNull())
    cover = candidates.where("depth > 2").select(F.explode(longer).alias("s"), "a").groupBy("s").agg(F.max("a").alias("longest")).select("s.*", "longest")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    return candidates.join(cover, _IDS, "left").where(F.col("longest").isNull() | (100 * whole("longest") < COVER * whole("a"))).drop("longest")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int | None = TOP, shard_words: int = SHARD_WORDS, owners: int | None = None
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases of two to four words (top; None: of all).

    a counts the phrase, l and r the parts of its lowest-scoring cut (the first of equal ones), n
    all words of the language. Occurrences overlap, and end with their piece. A null language is
    `und`, an empty one is a language like any other; a null text is empty. Rows that repeat count
    each time, their ids are not looked at. Equal scores are ranked by a, then by the phrase in
    UTF-8 order. Texts of any length are read whole. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    candidates, numbered, totals = phrase_candidates(docs, text_col, lang_col, least, shard_words, owners)
    lang_of = numbered.select(F.col("id").alias("w1"), "lang")
    kept = _uncovered(candidates).join(lang_of, "w1")
    if top is not None:
        kept = kept.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= top).drop("_rank")
    kept = materialise(kept, "phrase-kept")
    spelled = kept.select(*_IDS, F.posexplode(F.slice(F.array(*_IDS), F.lit(1), F.col("depth"))).alias("at", "id")).join(numbered.select("id", "word"), "id")
    spelled = spelled.groupBy(*_IDS).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"])).alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(spelled, _IDS).withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, z, unnest(list_transform(range(1, len(w) - z + 2), lambda i: w[i:i + z - 1])) AS ws FROM p, range(1, 5) AS r(z) WHERE len(w) >= z),
    f AS (SELECT lang, ws, count(*) AS a FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(ws) = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE len(ws) > 1 AND a >= 30),
    cuts AS (SELECT c.lang, c.ws, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
             FROM c, range(1, 4) AS q(k) JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1:k] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[k + 1:len(c.ws)] WHERE k < len(c.ws)),
    lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS o FROM cuts) WHERE o = 1),
    inner_ AS (SELECT lang, a, unnest(list_transform(range(1, len(ws) - z + 2), lambda i: ws[i:i + z - 1])) AS ws FROM c, range(2, 4) AS r(z) WHERE len(ws) > z),
    cover AS (SELECT lang, ws, max(a) AS longest FROM inner_ GROUP BY ALL),
    kept AS (SELECT w.* FROM lowest w LEFT JOIN cover USING (lang, ws) WHERE longest IS NULL OR 100 * longest < 80 * w.a),
    ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM kept)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
