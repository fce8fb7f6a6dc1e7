"""Embedding links on vectors that lean to one side: recall against all pairs, and lists that stay short."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup
from tessera.llm.embedding_dedup import PivotTable, shared_places, spread_pivots


def leaning(rng, n, width, mean):
    """Unit vectors whose cosine with one another is the mean."""
    side = rng.normal(size=width)
    x = mean**0.5 * side / np.linalg.norm(side) + (1 - mean) ** 0.5 * rng.normal(size=(n, width)) / width**0.5
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("flat, mean, shifted, least", [(1024, 0.0, False, 0.95), (32, 0.0, False, 0.95), (1024, 0.7, False, 0.95), (32, 0.7, False, 0.95), (1024, 0.7, True, 0.9)])
def test_recall_whatever_the_mean_cosine(spark, monkeypatch, flat, mean, shifted, least):
    """Links from 0.9 upwards against all pairs, searched flat and by cells; shifted: all copies are moved to one other side."""
    monkeypatch.setattr(PivotTable.__init__, "__defaults__", (flat, embedding_dedup.CELLS))
    rng = np.random.default_rng(11)
    x = leaning(rng, 6000, 48, mean)
    x, aside = x[:4000], leaning(rng, 2000, 48, mean) if shifted else x[4000:]
    aside = aside - (aside * x[:2000]).sum(axis=1, keepdims=True) * x[:2000]
    at = rng.uniform(0.89, 0.96, size=(2000, 1))
    x = np.concatenate([x, at * x[:2000] + (1 - at**2) ** 0.5 * aside / np.linalg.norm(aside, axis=1, keepdims=True)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.9
    true = near.sum(axis=1) - 1
    got = dict(embedding_dedup.embedding_dedup(df).select("vec_id", "n_links").collect())
    found = np.array([got[i] for i in range(len(x))])
    asked = np.arange(0, len(x), 100)
    assert (found <= true).all() and true[asked].sum() >= 20
    assert found.sum() >= least * true.sum() and found[asked].sum() >= 0.9 * true[asked].sum()


def test_lists_stay_short_as_vectors_double(spark):
    """Leaning vectors have as many pivots as are asked for, and the longest list does not grow with the table."""
    rng = np.random.default_rng(12)
    longest = []
    for n in (8_000, 16_000):
        x = leaning(rng, n, 64, 0.7)
        count, mean = n // embedding_dedup.PER_PIVOT, x[:2048].mean(axis=0)
        table = PivotTable(spread_pivots(embedding_dedup._less(x[: 2 * count], mean), count), mean=mean)
        assert len(table.pivots) == count
        lists = np.bincount(table.nearest(x, 8).ravel(), minlength=count)
        longest.append((lists.max(), np.median(lists)))
    assert longest[1][0] < 1.4 * longest[0][0] and longest[1][1] < 1.2 * longest[0][1]


def test_shared_pivots_stand_at_like_places():
    p, q = np.array([[1, 2, 3, 4], [5, -1, -1, -1]]), np.array([[4, 2, 9, 3], [7, -1, -1, 5]])
    assert shared_places(p, q, 1).tolist() == [[False, True, True, False], [False] * 4]
    assert shared_places(p, q, 3).tolist() == [[False, True, True, True], [True, False, False, False]]


def test_fit_takes_more_pivots_where_links_are_harder_to_tell():
    rng = np.random.default_rng(13)
    chosen = []
    for mean in (0.0, 0.5, 0.7):
        x = leaning(rng, 1536, 64, mean)
        middle = x.mean(axis=0)
        table = PivotTable(spread_pivots(embedding_dedup._less(x[:512], middle), 256), mean=middle)
        table.fit(x[-1024:], 0.9, 2)
        chosen.append(table.k)
        assert table.shared == 2 and table.gap == 3 * table.k // 4
    assert chosen == sorted(chosen) and chosen[0] < chosen[2] <= embedding_dedup.MOST_NEAREST


def test_vectors_at_one_place(spark):
    """Many vectors around one direction, as near to the mean as to each other, and a few aside."""
    rng = np.random.default_rng(14)
    side = rng.normal(size=24)
    x = np.concatenate([side + 0.2 * rng.normal(size=(900, 24)), rng.normal(size=(60, 24))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum() - len(x)
    got = embedding_dedup.embedding_dedup(df).agg(F.sum("n_links").alias("n"), F.countDistinct("component_id").alias("c")).first()
    assert 0.9 * true <= got["n"] <= true and got["c"] <= 61
