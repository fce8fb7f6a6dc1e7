"""Token-id tables: Parquet files with a delta-encoded id list for each document.

Rows lie in ascending id order over and within the files. The id list is written with
DELTA_BINARY_PACKED pages and Zstandard, the metadata columns with dictionaries or deltas;
row groups are small and carry page indexes, so a reader can fetch the metadata columns,
or the ids of a range of documents, without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.base import materialise, new_path, small_batches, text_groups
from tessera.llm.tokenize import encoder, release, vocabulary_path

#: Ids that a file is meant to hold; the number of files follows from it.
FILE_TOKENS = 8_000_000
#: Rows of the lists that go to the writer at once.
_ROWS = 256

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#tokens.list.element": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, tokens array<int>"


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every document's ids."""
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.uint32(end)), bounds + np.arange(n + 1)


def pack_ids(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The documents' ids as bytes, two for each id where all of them fit, else four."""
    small = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * small.itemsize).astype(np.int32)), pa.py_buffer(small)])


def unpack_ids(codes: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """Undo pack_ids, given how many ids each document has."""
    return [np.frombuffer(c, dtype="<u2" if len(c) == 2 * n else "<u4") for c, n in zip(codes, sizes)]


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_groups(batches):
            ids, bounds = with_end(*encoder(path).encode(batch.column("text")), end)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pack_ids(ids, bounds)], names=["doc_id", "n_tokens", "code"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range of ids in order, their ids as lists, with where each begins in the range."""
    release()
    part, at = TaskContext.get().partitionId(), 0
    for whole in batches:
        for lo in range(0, whole.num_rows, _ROWS):
            batch = whole.slice(lo, _ROWS)
            n = batch.column("n_tokens").to_numpy()
            docs = unpack_ids(batch.column("code").to_pylist(), n.tolist())
            bounds = np.append(0, np.cumsum(n))
            tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(docs).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(at + bounds[:-1]), pa.array(n), tokens],
                names=["doc_id", "part", "part_start", "n_tokens", "tokens"],
            )
            at += int(bounds[-1])


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> None:
    """Encode every whole text (null: empty) and write the files in ascending id order, null ids first.

    Texts are encoded where they lie; only ids are dealt to the files, whose number follows from
    all ids. part numbers the files' ranges and part_start counts the ids before the document
    within its range. Rows that repeat an id are kept, ordered among themselves by their ids'
    bytes. Other columns are ignored, whatever their names. An empty table leaves an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    coded = materialise(rows.mapInArrow(_encode(vocabulary or vocabulary_path(), end_id), "doc_id bigint, n_tokens bigint, code binary"), "token-ids")
    tokens = coded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    order = F.col("doc_id").asc_nulls_first()
    ranged = coded.repartitionByRange(max(1, -(-tokens // file_tokens)), order, F.substring("code", 1, 16)).sortWithinPartitions(order, F.col("code"))
    with small_batches(docs.sparkSession, _ROWS):
        ranged.mapInArrow(_lists, SCHEMA).write.options(**WRITE_OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of token files; naming columns reads no others from the files."""
    table = spark.read.schema(SCHEMA).parquet(path)
    return table.select(*columns) if columns else table


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        bounds = lists.offsets.to_numpy()
        flat = lists.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("part_start"), batch.column("n_tokens"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "part_start", "n_tokens", "_n", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    A range's first id count is the sum over the ranges before it: one row a range (a write task)
    goes through one running sum, and meets the documents of its range by a join.
    """
    totals = read_token_files(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    rows = read_token_files(spark, path, ["doc_id", "part", "part_start", "n_tokens", "tokens"])
    read = materialise(rows.mapInArrow(_checksums, "doc_id bigint, part int, part_start bigint, n_tokens bigint, _n bigint, ids_crc32 bigint"), "token-digest")
    same = F.when(F.col("_n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a token list is not as long as its file says")).cast("long"))
    return read.join(bases, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), same.alias("n_tokens"), "ids_crc32")


def token_table(docs: DataFrame, **options) -> DataFrame:
    """Write docs as token files in the shared folder and return the digest of what they hold."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, **options)
    return token_digest(docs.sparkSession, path)
