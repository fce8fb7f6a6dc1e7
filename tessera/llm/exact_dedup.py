"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every input partition (a block) sorts its distinct 48-bit text hashes, cuts them at the
   owners' hash ranges and Golomb-Rice codes the gaps; one compressed row goes to each owner.
2. An owner decodes its rows, finds the hashes that more than one block sent, and answers each
   block with a bitmap over the hashes of its row. A hash met twice within a block is marked
   by the block itself, so a hot text costs an owner one hash a block, however many copies.
3. Only texts whose bit is set (suspects) are shuffled: a screen by their hashes lets them
   through the scan, and one in some hundreds of the others. They are grouped by SHA-256 and
   by the whole text, which is the byte comparison; the partial aggregation sends one row for
   each text and task.
4. What a group decides goes to one row for each block and text, and from there to the block's
   rows, so the copies of a hot text never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import discard, materialise, screened, sha_of, shuffle_partitions, without

HASH_BITS = 48
#: Hashes that an owner is meant to hold (8 bytes each when decoded); the owners follow from it and the rows.
OWNER_HASHES = 2_000_000

_BLOCKS = "block int, owner int, n int, rice int, code binary, first int, ids array<bigint>, runs array<int>, shas binary"


def golomb_rice(values: np.ndarray, rice: int) -> bytes:
    """Code non-negative integers: the unary quotients of all, then their rice-bit remainders, packed into bytes."""
    if not len(values):
        return b""
    ends = np.cumsum((values >> np.uint64(rice)).astype(np.int64) + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 0
    rests = (values[:, None] >> np.arange(rice - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(np.concatenate([unary, rests.astype(np.uint8).ravel()])).tobytes()


def golomb_rice_decode(code: bytes, n: int, rice: int) -> np.ndarray:
    """Undo golomb_rice for n values."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    zeros = np.flatnonzero(bits == 0)[:n]
    quotient = np.diff(zeros, prepend=-1) - 1
    rests = bits[zeros[-1] + 1 : zeros[-1] + 1 + n * rice].reshape(n, rice).astype(np.uint64)
    powers = np.uint64(1) << np.arange(rice - 1, -1, -1, dtype=np.uint64)
    return (quotient.astype(np.uint64) << np.uint64(rice)) + (rests * powers).sum(axis=1, dtype=np.uint64)


def _code_blocks(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        hashes = table["hash"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint64)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        ids = table["doc_id"].combine_chunks().take(pa.array(order))
        shas = np.frombuffer(b"".join(table["sha"].combine_chunks().to_pylist()), dtype=np.uint8).reshape(-1, 32)[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        runs = np.diff(np.append(first, len(hashes)))
        distinct = hashes[first]
        owner = ((distinct * np.uint64(owners)) >> np.uint64(HASH_BITS)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rows = []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(distinct))):
            own = distinct[lo:hi]
            base = np.uint64(-(-(int(owner[lo]) << HASH_BITS) // owners))
            gaps = np.diff(own, prepend=base)
            rice = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69))))
            a, b = first[lo], first[hi] if hi < len(first) else len(hashes)
            rows.append((block, int(owner[lo]), len(own), rice, golomb_rice(gaps, rice), int(a), ids[a:b].to_pylist(), runs[lo:hi].tolist(), shas[a:b].tobytes()))
        names = ("block", "owner", "n", "rice", "code", "first", "ids", "runs", "shas")
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64]), types)], names=list(names))

    return run


def _mark_for(owners: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One owner's answer: for each block's row a bitmap of the hashes that other blocks also sent."""
        base = np.uint64(-(-(int(rows["owner"].iloc[0]) << HASH_BITS) // owners))
        parts = [np.cumsum(golomb_rice_decode(c, n, r)) + base for c, n, r in zip(rows["code"], rows["n"], rows["rice"])]
        found, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        repeated = (counts > 1)[inverse]
        ends = np.cumsum([len(p) for p in parts])
        maps = [np.packbits(x).tobytes() for x in np.split(repeated, ends[:-1])]
        return pd.DataFrame({"block": rows["block"].to_numpy(), "owner": rows["owner"].to_numpy(), "bitmap": maps})

    return run


def _read_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every block with what its owners answered; pos numbers the rows of a block."""
    for batch in batches:
        for row in batch.to_pylist():
            runs = np.asarray(row["runs"])
            hit = np.unpackbits(np.frombuffer(row["bitmap"], dtype=np.uint8), count=row["n"]).astype(bool) | (runs > 1)
            n = len(row["ids"])
            shas = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 32 * n + 1, 32, dtype=np.int32)), pa.py_buffer(row["shas"])])
            columns = [pa.array(row["ids"], pa.int64()), pa.array(np.full(n, row["block"], np.int32)), pa.array(row["first"] + np.arange(n, dtype=np.int32)), shas, pa.array(np.repeat(hit, runs))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "block", "pos", "sha", "suspect"])


def _groups(docs: DataFrame, id_col: str, text_col: str, owners: int | None) -> DataFrame:
    """One row per input row: doc_id, sha, keep_id, group_size, kept."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    owners = owners or max(shuffle_partitions(docs.sparkSession), -(-docs.count() // OWNER_HASHES))
    hashed = base.select("doc_id", F.xxhash64("_text").bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias("hash"), sha_of(F.col("_text")).alias("sha"))
    blocks = materialise(hashed.mapInArrow(_code_blocks(owners), _BLOCKS), "dedup-blocks")
    sent = blocks.select("block", "owner", "n", "rice", "code").repartition(owners, "owner")
    answers = sent.groupBy("owner").applyInPandas(_mark_for(owners), "block int, owner int, bitmap binary")
    marked = materialise(
        blocks.select("block", "owner", "n", "first", "ids", "runs", "shas").join(answers, ["block", "owner"]).mapInArrow(_read_answers, "doc_id bigint, block int, pos int, sha binary, suspect boolean"),
        "dedup-marked",
    )
    discard(blocks)
    suspects = marked.where("suspect")
    texts, _ = screened(base.withColumn("_sha", sha_of(F.col("_text"))), F.col("_sha"), suspects, F.col("sha"))
    groups = texts.groupBy("_sha", "_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").select(F.col("_sha").alias("sha"), "keep_id", "group_size")
    held = suspects.groupBy("block", "sha").agg(F.max(F.struct("doc_id", "pos")).alias("top"))
    stay = held.groupBy("sha").agg(F.max(F.struct(F.col("top.doc_id").alias("doc_id"), "block", F.col("top.pos").alias("pos"))).alias("stay"))
    decided = held.select("block", "sha").join(groups.join(stay, "sha"), "sha")
    shared = suspects.join(decided, ["block", "sha"], "left").select(
        "doc_id",
        "sha",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce((F.col("stay.block") == F.col("block")) & (F.col("stay.pos") == F.col("pos")), F.lit(True)).alias("kept"),
    )
    alone = marked.where("not suspect").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(shared)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the row
    with the largest id stays. A null id is below every other id; when all ids of a group are
    null, keep_id is null. Exactly one row of a group has kept = true: where rows repeat both
    id and text, one of them. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    return _groups(docs, id_col, text_col, owners).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that exact_dedup drops; columns, whatever their names, and kept rows are unchanged.

    Texts and ids are taken as exact_dedup takes them: null texts are empty ones, and a null id
    is the smallest. A row is known by its id and its text's SHA-256, so other texts of a null or
    repeated id stay; of rows that repeat both, one stays, no stated one. An empty table stays
    empty.
    """
    copies = _groups(docs, id_col, text_col, None).where("group_size > 1")
    fate = copies.groupBy("doc_id", "sha").agg(F.bool_or("kept").alias("keep"), F.count(F.lit(1)).alias("n")).where("not keep or n > 1")
    return without(docs, materialise(fate.select("doc_id", "sha", "keep"), "dedup-fate"), id_col, text_col)
