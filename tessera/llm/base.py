"""What the corpus operators share: tables cut from their lineage, joins that split hot keys, components, Arrow helpers."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole texts are long, so few rows go into each Arrow batch between Spark and Python.
BATCH_ROWS = 512
#: Texts are worked on in groups of about this many bytes, whatever an Arrow batch holds.
GROUP_BYTES = 4_000_000
#: A screen has this many bits for each wanted key, whatever their number; of other keys one in some hundreds then passes.
KEY_BITS = 24
#: Wanted keys of one screen at most: its broadcast has 96 MB. More are parted by hash range, with a screen and a scan each.
SCREEN_KEYS = 1 << 25
#: 64-bit words in a row of a screen: 2**6, as shifts by 6 below rely on.
_PAGE = 64
_BLANK = re.compile(rb"[\x20\x09]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local master gets a temporary folder; on a cluster that would part the
    data, so it is an error there.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder below the shared one, which may go once the application has ended."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Bound the rows of an Arrow batch for what is run inside; the session has its own setting again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage for good."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a materialised table that nothing will read again."""
    context = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_groups(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of all batches in groups of about GROUP_BYTES of text; a longer text is a group of its own.

    Groups are copies: Arrow's string functions can go wrong on slices of an array.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = bytes_and_offsets(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP_BYTES, side="right")) - 1)
            yield batch.take(pa.array(np.arange(at, stop)))
            at = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def text_parts(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about so many bytes, cut at blanks only, so that a long text's words are never all held at once."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + size)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte array over all texts of a column, and where each text begins and ends; a null has no bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def sha_of(text: Column) -> Column:
    """The SHA-256 of a text as bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _mask(key: Column) -> Column:
    """Four bits of a word, by a hash of the key."""
    own = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(own, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _pages(keys: DataFrame, words: int, page: str, bits: str) -> DataFrame:
    """The words of a Bloom filter over the column key, so many to a row: at most words / _PAGE rows of an array each."""
    word = F.pmod(F.xxhash64("key"), F.lit(words))
    held = keys.groupBy(word.alias("word")).agg(F.bit_or(_mask(F.col("key"))).alias("mask"))
    found = held.groupBy(F.shiftright("word", 6).alias(page)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(_PAGE - 1)).cast("int").alias("at"), "mask"))).alias("of"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(_PAGE - 1)), lambda at: F.coalesce(F.element_at("of", at), F.lit(0).cast("long")))
    return found.select(page, dense.alias(bits))


def screened(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, most: int = SCREEN_KEYS) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose key may be one of the wanted keys, and those whose key surely is not.

    The wanted keys' hashes are counted and then set in a Bloom filter of KEY_BITS bits for each,
    which is broadcast; so the share of other rows that passes is the same at every size. Above
    `most` keys they are parted by hash range: rows are scanned once for each range, and each
    range has a filter of its own, so a broadcast stays within most * KEY_BITS bits. A null key
    is a key like any other.
    """
    hashes = wanted.select(F.xxhash64(wanted_key).alias("key")).distinct()
    n = hashes.count()
    ranges = max(1, -(-n // most))
    words = _PAGE * max(1, -(-n * KEY_BITS // (64 * _PAGE * ranges)))
    page, bits, own = (unused(rows, name) for name in ("_page", "_bits", "_key"))
    keyed = rows.withColumn(own, F.xxhash64(key))
    of = lambda c: F.pmod(F.xxhash64(c, F.lit(2)), F.lit(ranges))
    word = F.pmod(F.xxhash64(own), F.lit(words))
    held = F.coalesce(F.get(F.col(bits), word.bitwiseAND(F.lit(_PAGE - 1)).cast("int")).bitwiseAND(_mask(F.col(own))) == _mask(F.col(own)), F.lit(False))
    parts: tuple[list[DataFrame], list[DataFrame]] = ([], [])
    for k in range(ranges):
        filled = _pages(hashes.where(of(F.col("key")) == k), words, page, bits)
        flagged = keyed.where(of(F.col(own)) == k).join(F.broadcast(filled), F.shiftright(word, 6) == F.col(page), "left")
        parts[0].append(flagged.where(held).drop(own, page, bits))
        parts[1].append(flagged.where(~held).drop(own, page, bits))
    return reduce(DataFrame.unionByName, parts[0]), reduce(DataFrame.unionByName, parts[1])


def join_spread(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined to the one row that facts has for each key.

    rows has a column block, which numbers the partitions it was written in. The facts first meet
    one row for each block and key, and the rows then meet these; so the rows of a hot key stay
    in as many parts as there are blocks.
    """
    met = rows.select("block", key).distinct().join(facts, key)
    return rows.join(met, ["block", key])


def without(docs: DataFrame, fate: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs less the rows that fate names.

    fate has one row for each id and SHA-256 (doc_id, sha, keep) that loses a row: all of its
    rows go, but for one where keep is true. Only rows that the screen lets through move.
    """
    name = unused(docs, "_fate")
    identity = lambda i, sha: F.concat(F.hex(sha), F.lit("|"), F.coalesce(i.cast("string"), F.lit("")))
    own = docs.withColumn(name, identity(docs[id_col].cast("long"), sha_of(docs[text_col])))
    named, keep = unused(own, "_named"), unused(own, "_keep")
    fate = fate.select(identity(F.col("doc_id"), F.col("sha")).alias(named), F.col("keep").alias(keep))
    maybe, clear = screened(own, F.col(name), fate, F.col(named))
    met = maybe.join(fate, F.col(name) == F.col(named), "left")
    stays = met.where(F.col(named).isNull()).drop(named, keep)
    one = met.where(F.col(keep)).drop(named, keep).dropDuplicates([name])
    return clear.unionByName(stays).unionByName(one).drop(name)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Components of an undirected graph, as rows (node, root) with root the smallest node; nodes without links are left out.

    edges has two columns (a, b) of one comparable type. Alternates large-star and small-star
    steps (Kiveris et al., 2014) until nothing changes, which takes rounds by the logarithm of
    the graph; edges stay linear in it. Every round is a table in the shared folder, so no
    lineage builds up and nothing of the graph reaches the driver but one count and one
    checksum. The joins are on a node and leave a hub's rows to the adaptive skew join.
    """
    current = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = _mark(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        following = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        after = _mark(following)
        discard(current)
        current = following
        if after == before:
            break
        before = after
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(row["n"]), int(row["h"])
