"""Repeated passages against a count of all runs, with shards and owners cut small."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substrings
from tessera.llm.packed import flags, pack, unflags, unpack

SCHEMA = "doc_id long, text string, n bigint, words string, shard int, kept boolean"


def by_hand(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    runs = Counter(tuple(w[k : k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = {p for k in range(len(w) - window + 1) if runs[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def found(df, **sizes):
    out = []
    for r in substrings.remove_repeats(df, **sizes).collect():
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        out.append((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["kept"]))
    return sorted(out, key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", 2, True) for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("window", "shard_words", "owners"), [(5, 30, 3), (6, 1, 1), (1, 200, 5), (2, 50, None)])
def test_repeats_of_few_words(spark, window, shard_words, owners):
    draw = random.Random(window)
    rows = [(k, " ".join(draw.choice("abc") for _ in range(draw.randrange(0, 14)))) for k in range(60)]
    rows += [(None, None), (7, ""), (7, "  \t\n"), (99, "a " * 40), (99, "a " * 40), (98, "x\x1cy z É é \x0b q")]
    assert found(frame(spark, rows), window=window, shard_words=shard_words, owners=owners) == by_hand(rows, window)


def test_passages_of_whole_windows(spark):
    """Passages at any place of a document, at its ends and cut by one word, one of them in a third of all documents."""
    draw = random.Random(3)
    text = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    passage, short, tail = text(36), text(34), text(90)
    rows = []
    for k in range(60):
        words = text(draw.randrange(0, 60))
        at = draw.randrange(len(words) + 1)
        middle = passage if k % 3 == 0 else short if k % 3 == 1 else tail[k % 7 :] if k % 2 else []
        rows.append((k, " ".join(words[:at] + middle + words[at:])))
    rows += [(100, " ".join(text(30_000))), (101, rows[5][1]), (102, "word " * 50), (103, "b" * 3_000_000 + " c")]
    df = frame(spark, rows, 4)
    assert found(df, shard_words=700, owners=7) == by_hand(rows, 35)
    digests = {(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_digests(df).collect()}
    assert digests == {(i, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, _, gone, kept in by_hand(rows, 35)}


def test_no_documents(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(frame(spark, [(1, None)])) == [(1, 0, 0, "")]


def test_only_windows_about_hits_are_sent_on(spark):
    """Runs are hashed around hits alone: of texts without repeats nothing is sent in the second exchange."""
    rows = [(k, " ".join(f"w{k}-{j}" for j in range(200))) for k in range(20)]
    shards = substrings.shards_of(frame(spark, rows), "doc_id", "text", 500)
    for row in shards.collect():
        shard, starts, *_ = substrings._candidate_runs({**row.asDict(), "hits": None}, 35, 40)
        assert not len(starts) and len(shard.anchors(40)[0]) == sum(c - 17 for c in row["counts"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=300))
def test_packed_numbers(values):
    assert unpack(pack(np.array(values, np.uint64))).tolist() == values
    assert unflags(flags(np.array(values, np.uint64) % np.uint64(2)), len(values)).tolist() == [v % 2 == 1 for v in values]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 37))
def test_rolling_tells_runs_apart(words, width):
    hashes = substrings.rolling(np.array(words, np.uint64) + np.uint64(1), width)
    runs = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
    assert len(hashes) == len(runs) and len(set(hashes.tolist())) == len(set(runs)) and len(set(zip(runs, hashes.tolist()))) == len(set(runs))
