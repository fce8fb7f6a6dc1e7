"""Delimited text with quoted line breaks, read by as many tasks as its size asks for.

A range of a file begins at a line, and a line begins a record or stands within a quoted field;
which of both is known only from what comes before. So each range is first walked under both
assumptions, which gives what it makes of either; composed from the file's start on, these say how
each range begins. Then every range is cut into records from its known state. A record that passes
the end of a range is put together from its pieces.

The states of ranges are broadcast: two numbers and a flag for each range of maxPartitionBytes, so
some 20 MB for 100 TB of text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_INSIDE = re.compile(r'(?:[^"]+|"")*')
_PIECES = "file bigint, start bigint, seq bigint, kind int, piece string"
HEAD, RECORD, TAIL = 0, 1, 2


def state_after(line: str, inside: bool, separator: str) -> bool:
    """Whether the end of a line stands within a quoted field, given that of its beginning. A quote opens a field at its first sign only."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = _INSIDE.match(line, at).end()
            if at == len(line):
                return True
            inside, at = False, at + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at += 1


def _walk(separator: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each range: its states at the end, for both at the beginning."""
        key, ends, out = None, [False, True], []
        for batch in batches:
            for file, start, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (file, start) != key:
                    if key is not None:
                        out.append((*key, *ends))
                    key, ends = (file, start), [False, True]
                ends = [state_after(line, e, separator) for e in ends] if '"' in line else ends
        if key is not None:
            out.append((*key, *ends))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["file", "start", "from_out", "from_in"])

    return run


def _cut(separator: str, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole records of ranges; or, for edges, the pieces before the first and after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, held, seq, kind, rows = None, False, [], 0, RECORD, []

        def end(final: int) -> None:
            if held and (final != RECORD) == edges:
                rows.append((*key, seq, final, "\n".join(held)))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["file", "start", "seq", "kind", "piece"])

        for batch in batches:
            for file, start, began_inside, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (file, start) != key:
                    if key is not None:
                        end(HEAD if kind == HEAD else TAIL)
                    key, inside, held, seq, kind = (file, start), began_inside, [], 0, HEAD if began_inside else RECORD
                held.append(line)
                inside = state_after(line, inside, separator)
                if not inside:
                    end(kind)
                    held, seq, kind = [], seq + 1, RECORD
            if rows:
                yield batch_of(rows)
                rows.clear()
        if key is not None:
            end(HEAD if kind == HEAD else TAIL)
            if rows:
                yield batch_of(rows)

    return run


def ranges(lines: DataFrame, separator: str) -> DataFrame:
    """file, start, inside, ends_inside of each range of lines (file, start, line): how it begins and ends."""
    walked = lines.mapInArrow(_walk(separator), "file bigint, start bigint, from_out boolean, from_in boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a range sets the state (both ends alike), keeps it, or turns it round
    turned = F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)
    numbered = walked.withColumn("turns", F.sum(turned).over(upto)).withColumn("sets", F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("state"), F.col("turns").alias("at"))))
    last, turns = F.last("sets", ignorenulls=True).over(before), F.coalesce(F.max("turns").over(before), F.lit(0))
    begun = numbered.withColumn("inside", (F.coalesce(last["state"], F.lit(0)) + turns - F.coalesce(last["at"], F.lit(0))) % 2 == 1)
    return begun.select("file", "start", "inside", F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("ends_inside"))


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """record, header of the records of delimited files: their text, and whether a record is the first of its file. Blank records are left out."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    states = ranges(lines, separator)
    known = lines.join(F.broadcast(states), ["file", "start"]).select("file", "start", "inside", "line", "ends_inside")
    whole = known.drop("ends_inside").mapInArrow(_cut(separator, False), _PIECES)
    edges = known.where("inside or ends_inside").drop("ends_inside").mapInArrow(_cut(separator, True), _PIECES)
    earlier = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.col("kind") == TAIL, F.struct("start", "seq")), ignorenulls=True).over(earlier)
    owned = edges.withColumn("own", F.when(F.col("kind") == TAIL, F.struct("start", "seq")).otherwise(began))
    joined = owned.groupBy("file", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "kind", "piece"))), lambda p: p["piece"]), "\n").alias("piece"))
    every = whole.select("file", "start", "seq", "piece").unionByName(joined.select("file", "own.start", "own.seq", "piece"))
    out = every.select(F.regexp_replace("piece", r"\r$", "").alias("record"), ((F.col("start") == 0) & (F.col("seq") == 0)).alias("header"))
    return out.where("header or trim(record) <> ''")


def read(spark: SparkSession, path: str, names: list[str], separator: str = ",") -> DataFrame:
    """The rows of delimited files under the given names, all text, the first record of each file left out."""
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = F.from_csv("record", F.lit(schema), {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return records(spark, path, separator).where("not header").select(parsed.alias("r")).select("r.*")
