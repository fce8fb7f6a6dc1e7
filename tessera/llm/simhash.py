"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into two 32-bit segments and entered into one table for each, under the
segment's value. Fingerprints within two bits have a segment that differs in one bit at most, so a
probe enumerates the Hamming ball of radius one around its own segment, fetches the entries under
every value of it, and verifies the complete distance. A ball holds the segment and its values
with one more bit set: where two segments differ in one bit, one side lacks that bit and finds the
other.

A segment value with more than BUSY entries is split by the other segment: its entries and probes
meet under whole fingerprints, half way, an entry under those one bit from its other segment too.
All that meet there are within two bits, so tying each to the smallest keeps all that is
connected, and no pairs are made within a crowd.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import as_bytes, connected_components, join_spread, materialise, sha_of, text_groups, without

SEGMENTS, SEGMENT_BITS = 2, 32
DISTANCE = 2
#: Entries under one segment value that a probe compares itself with; values with more are split.
BUSY = 32
#: Bytes of a text whose shingles are held at once.
_PART = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SEGMENT = (1 << SEGMENT_BITS) - 1


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about _PART bytes, cut between words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PART)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint: a bit is set if over half of the shingles' XXH64 values have it."""
    from xxhash import xxh64_intdigest

    count, total, words = np.zeros(64, np.int64), 0, []
    for part in _parts(text):
        words = words[1 - width :] + part.lower().split() if total else words + part.lower().split()
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-width] + 1).tolist()]
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
        count += np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    if not total:
        return xxh64_intdigest(b" ".join(words), seed) if words else 0
    return int(np.packbits(count * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_groups(batches):
        prints = np.array([simhash(t) for t in as_bytes(batch.column("text"))], dtype=np.uint64)
        others = [c for c in batch.schema.names if c not in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64)), *(batch.column(c) for c in others)], names=["doc_id", "print", *others])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha: bool = False) -> DataFrame:
    """doc_id and print (the fingerprint's bits as a long) per row, and the text's SHA-256 if asked; null texts count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if sha:
        rows = rows.withColumn("sha", sha_of(F.col("text")))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, print bigint" + ", sha binary" * sha)


def _ball(value: Column) -> Column:
    """A segment's value and its values with one more bit set."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k))
    return F.concat(F.array(value), F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) == 0), lambda b: value.bitwiseOR(b)))


def _tagged(number: int, values: Column) -> Column:
    """Segment values under the number of their table."""
    return F.transform(values, lambda v: v.bitwiseOR(F.lit(number << SEGMENT_BITS)))


def _whole_keys(entry: Column) -> Column:
    """Under which whole fingerprints a probe (a, value) of a crowd meets others.

    Its fingerprint with the segment that it asks for; its own segment's crowd also finds it one
    bit away in the other segment.
    """
    number = F.shiftrightunsigned(entry["value"], SEGMENT_BITS)
    asked, a = entry["value"].bitwiseAND(F.lit(_SEGMENT)), entry["a"]
    own = F.when(number == 0, a.bitwiseAND(F.lit(_SEGMENT))).otherwise(F.shiftrightunsigned(a, SEGMENT_BITS))
    diff = own.bitwiseXOR(asked)
    key = a.bitwiseXOR(F.when(number == 0, diff).otherwise(F.shiftleft(diff, SEGMENT_BITS)))
    flips = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (k + SEGMENT_BITS * (1 - number)).cast("int")))
    return F.when(diff == 0, F.concat(F.array(a), F.transform(flips, lambda f: a.bitwiseXOR(f)))).otherwise(F.array(key))


def candidates(prints: DataFrame, busy: int = BUSY) -> DataFrame:
    """Pairs (a, b) of fingerprints that a segment table brings together, near or not; of a crowd, ties that connect what is near.

    prints has distinct values. The joins are by merge whatever the sizes, so the plan behaves
    alike on small and large input.
    """
    segments = [F.shiftrightunsigned("print", SEGMENT_BITS * k).bitwiseAND(F.lit(_SEGMENT)) for k in range(SEGMENTS)]
    table = prints.select(F.explode(F.concat(*[_tagged(k, F.array(s)) for k, s in enumerate(segments)])).alias("value"), F.col("print").alias("b"))
    probes = prints.select(F.explode(F.concat(*[_tagged(k, _ball(s)) for k, s in enumerate(segments)])).alias("value"), F.col("print").alias("a"))
    crowds = table.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > busy).select("value")
    few = probes.join(crowds.hint("merge"), "value", "left_anti").join(table.hint("merge"), "value").where("a <> b").select("a", "b")
    crowded = probes.join(crowds.hint("merge"), "value", "left_semi")
    keys = crowded.select("a", F.explode(_whole_keys(F.struct("value", "a"))).alias("key"))
    lowest = keys.groupBy("key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    ties = keys.join(lowest.hint("merge"), "key").where("a <> b").select("a", "b")
    return few.unionByName(ties)


def fingerprint_links(prints: DataFrame, busy: int = BUSY) -> DataFrame:
    """Links (a, b) that connect all fingerprints at distance two or less: the candidates whose complete distance is."""
    return candidates(prints, busy).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of two or fewer differing bits,
    the row's own included; null ids count as no id, so a component of them alone has a null
    component_id. Empty, null and blank texts have fingerprint zero, which links like any
    other. Rows that repeat an id are kept. An empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, id_col, text_col).withColumn("block", F.spark_partition_id()), "simhash")
    return _with_components(rows).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def _with_components(rows: DataFrame) -> DataFrame:
    """rows of fingerprints (doc_id, print, block) with their component: root (its smallest fingerprint) and component_id."""
    prints = materialise(rows.groupBy("print").agg(F.min("doc_id").alias("low_id")), "simhash-prints")
    nodes = connected_components(fingerprint_links(prints.select("print")), "simhash-links")
    rooted = prints.join(nodes.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    lows = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    found = materialise(rooted.join(lows, "root").select("print", "root", "component_id"), "simhash-components")
    return join_spread(rows, found, "print")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of every component, that of the smallest id; columns, whatever their names, and kept rows are unchanged.

    Null, empty and blank texts are one component by their fingerprint zero. A null id is above
    every other id. A row is known by its id and its text's SHA-256: of rows of one id the
    smaller SHA-256 stays, and of rows that repeat both, one stays, no stated one. An empty
    table stays empty.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, sha=True).withColumn("block", F.spark_partition_id()), "simhash")
    found = materialise(_with_components(rows).select("doc_id", "sha", "root", "block"), "simhash-rooted")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("sha").alias("sha"))
    stay = found.groupBy("root").agg(F.min(order).alias("stay"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = join_spread(found, stay, "root").withColumn("keep", F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("sha") == F.col("stay.sha")))
    fate = met.groupBy("doc_id", "sha").agg(F.bool_or("keep").alias("keep"), F.count(F.lit(1)).alias("n")).where("not keep or n > 1")
    return without(docs, materialise(fate.select("doc_id", "sha", "keep"), "simhash-fate"), id_col, text_col)
