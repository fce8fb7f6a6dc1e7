"""Source divergence against a plain count over all terms and sources."""

import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n bigint, p string, block int, term string"
ROWS = [
    *[(i, f"alpha beta beta {'gamma' * (i % 3)} Ünder under", "en", f"s{i % 4}") for i in range(24)],
    *[(i, f"alpha delta delta, ALPHA x{i}", "en", None) for i in range(6)],
    *[(i, "eins zwei drei" if i % 2 else "eins, vier", "de", "s1" if i < 9 else "s2") for i in range(14)],
    (None, None, None, None), (1, "", "fr", "a"), (2, "seul", "fr", "b"), (3, "1 2 3", "en", "digits"), (4, "mot " * 40_000, "en", "long"), (4, "mot " * 40_000, "en", "long"),
]


def by_hand(rows, least, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    counts, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source in rows:
        found = words(text or "")
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    for lang in {x for x, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, value, k + 1))
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 2), (1000, 10)])
def test_source_divergence(spark, least, top):
    df = spark.createDataFrame([(*r, 0, "x", 1, "y") for r in ROWS], SCHEMA).repartition(3)
    got = [tuple(r) for r in divergence.source_divergence(df, least_docs=least, top=top).collect()]
    assert sorted(got) == by_hand(ROWS, least, top)


def test_source_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_in_many_parts_are_the_same(spark, monkeypatch):
    """Counts that a task passes on early add up to the same."""
    monkeypatch.setattr(divergence, "_HELD", 1)
    df = spark.createDataFrame([(*r, 0, "x", 1, "y") for r in ROWS], SCHEMA).repartition(2)
    assert sorted(tuple(r) for r in divergence.source_divergence(df).collect()) == by_hand(ROWS, 10, 10)


def test_shares_of_counts_beyond_64_bits(spark):
    row = spark.range(1).select(divergence._share(*(divergence.F.lit(x).cast("long") for x in (10**13, 3 * 10**13, 5))).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 10)
