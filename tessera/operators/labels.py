"""Many labels in one pass over each text, by an automaton of all of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = re.compile(r"-?\d+(?:\.\d+)?", re.ASCII)
_WORD = re.compile(r"\w", re.ASCII)


def automaton(labels: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for label in labels:
        found.add_word(label, label)
    found.make_automaton()
    return found


def marks(text: str, found: ahocorasick.Automaton) -> list[tuple[int, str]]:
    """(place, label): each label's occurrences from the left without overlaps, save those within what an earlier or longer one covers."""
    ends: dict[str, int] = {}
    held = []
    for last, label in found.iter(text):
        start = last + 1 - len(label)
        if start >= ends.get(label, 0):
            ends[label] = last + 1
            held.append((start, -(last + 1), label))
    out, reached = [], -1
    for start, end, label in sorted(held):
        if reached < -end:
            out.append((start, label))
        reached = max(reached, -end)
    return out


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, found = None, None
    for batch in batches:
        keep, places, labels = [], [], []
        for k, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("labels").to_pylist())):
            if not text or not own:
                continue
            if own != known:
                known, found = own, automaton(own)
            for place, label in marks(text, found):
                keep.append(k)
                places.append(place)
                labels.append(label)
        columns = [batch.column("answer").take(pa.array(keep, pa.int64())), pa.array(places, pa.int32()), pa.array(labels, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["answer", "label_pos", "label"])


def label_marks(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """answer, label_pos, label: where lower-case labels (answer, label) stand in answers (answer, text), save within a longer label's occurrence.

    A text is walked once, whatever the number of its labels. Empty and null labels stand nowhere.
    """
    own = labels.where("label <> ''").groupBy("answer").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    rows = answers.select("answer", F.lower("text").alias("text")).join(own, "answer").select("answer", "text", "labels")
    schema = T.StructType([answers.schema["answer"], T.StructField("label_pos", T.IntegerType()), T.StructField("label", T.StringType())])
    return rows.mapInArrow(_mark, schema)


def holds_token(text: str, found: ahocorasick.Automaton) -> bool:
    """One of the values stands in the text as a token of its own: not within a word, nor a number within a number."""
    for last, value in found.iter(text):
        before, after = text[last - len(value) : last - len(value) + 1] if last >= len(value) else "", text[last + 1 : last + 2]
        beside = [c for c in (before, after) if c]
        if not any(_WORD.match(c) or c == "." and _NUMBER.fullmatch(value) for c in beside):
            return True
    return False


def holds_any(text: Column, values: list[str]) -> Column:
    """Whether one of the values stands in the text as a token; words of one letter do not count. Null texts hold none."""
    own = sorted({v.strip().lower() for v in values if v is not None})
    own = [v for v in own if v and (len(v) >= 2 or _NUMBER.fullmatch(v))]
    if not own:
        return F.lit(False)

    @F.pandas_udf(T.BooleanType())
    def tell(texts: pd.Series) -> pd.Series:
        found = automaton(own)
        return texts.map(lambda t: bool(t) and holds_token(t, found))

    return tell(F.lower(text))
