"""Phrases against plain counts of all word runs, with shards and ranges cut small."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n bigint, word string, shard int, w1 int"


def by_hand(rows, least, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            f["und" if lang is None else lang].update(tuple(w[i : i + z]) for z in range(1, 5) for i in range(len(w) - z + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found, cover = [], Counter()
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), p, c[p[:k]], c[p[k:]]))
                for z in range(2, len(p)):
                    for i in range(len(p) - z + 1):
                        cover[p[i : i + z]] = max(cover[p[i : i + z]], a)
        kept = sorted(x for x in found if 100 * cover[x[3]] < 80 * -x[1])
        out += [(lang, k + 1, x[2].decode(), -x[1], x[4], x[5], n, -x[0]) for k, x in enumerate(kept[:top])]
    return sorted(out)


def texts(seed):
    draw = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "mat", "a", "is", "é", "日本", "x\x1cy", "big"]
    rows = []
    for k in range(120):
        found = [draw.choice(words) for _ in range(draw.randrange(0, 30))]
        text = "".join(w + draw.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "?! "]) for w in found)
        rows.append((text + draw.choice(["", " New York City hall", " rare" + str(k)]), draw.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), (None, None), (" . ;; \n", "fr"), ("only once here", "fr"), ("hot pair " * 3000, "en"), ("hot pair " * 3000, "en"), ("y" * 2_500_000 + " " + "z" * 1_500_000, "fr")]


@pytest.mark.parametrize(("least", "top", "shard_words", "owners"), [(2, 2000, 100, 40), (1, 5, 1, 7), (30, None, 1 << 21, None), (3, 7, 1000, 1)])
def test_collocations(spark, least, top, shard_words, owners):
    rows = texts(least)
    df = spark.createDataFrame([(k, t, lang, 5, "w", 1, 2) for k, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = [tuple(r) for r in collocations.collocations(df, least=least, top=top, shard_words=shard_words, owners=owners).collect()]
    assert sorted(got) == by_hand(rows, least, top)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.lists(st.integers(0, 5), min_size=8, max_size=8), st.integers(0, 1) )
def test_tries(words, bound, wide):
    """A trie read back is its sorted run; parts cut at bounds and merged again are it too."""
    sequence = np.array([*words, 0, 0, 0], np.int64) * (1 if not wide else 2**40)
    columns, counts = collocations.sorted_runs(collocations.suffixes(sequence))
    expected = Counter()
    for k, w in enumerate(words):
        if w:
            run = words[k : k + 4]
            run = run[: run.index(0)] if 0 in run else run
            expected[tuple((run + [0] * 4)[:4])] += 1
    scale = 2**40 if wide else 1
    assert [tuple(x) for x in (columns.T // scale).tolist()] == sorted(expected) and counts.tolist() == [expected[x] for x in sorted(expected)]
    bounds = np.unique(np.array(bound, np.int64).reshape(4, 2) * scale, axis=1)
    edges = np.concatenate([[0], collocations._cuts(columns, bounds), [columns.shape[1]]])
    parts = [collocations.read_trie(collocations.write_trie(columns[:, a:b], counts[a:b])) for a, b in zip(edges, edges[1:]) if b > a]
    for c, n in parts[:]:
        parts.append((c, n))
    if parts:
        merged, twice = collocations.sorted_runs(np.concatenate([c for c, _ in parts], axis=1), np.concatenate([n for _, n in parts]))
        assert (merged == columns).all() and (twice == 2 * counts).all()


def test_scores_beyond_64_bits(spark):
    lit = lambda x: collocations.F.lit(x).cast("long")
    a = 4 * 10**17
    assert spark.range(1).select(collocations._score(lit(a), lit(a + 7), lit(3 * a)).alias("s")).first()["s"] == 2_000_000 * a // (4 * a + 7)
