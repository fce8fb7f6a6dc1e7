"""Each stage of the corpus pipeline against its operator's rows, and the whole run."""

from collections import Counter, defaultdict

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from tessera.llm.base import materialise

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, DATA), name)
        out.append(docs)
    return out


def test_stages_keep_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_exact_stage_keeps_the_largest_of_each(stages):
    groups = defaultdict(list)
    for r in stages[1].collect():
        groups[r["text"]].append(r["doc_id"])
    assert {r["doc_id"] for r in stages[2].collect()} == {max(v) for v in groups.values()}


def test_simhash_stage_keeps_the_smallest_of_each(stages):
    from tests.llm.test_operators import components_by_hand, print_by_hand

    rows = stages[2].collect()
    prints = [print_by_hand(r["text"]) for r in rows]
    roots = components_by_hand([r["doc_id"] for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert {r["doc_id"] for r in stages[3].collect()} == set(roots)


def test_mixing_repeats_and_packing_holds_all(stages):
    copies = Counter(r["doc_id"] for r in stages[4].collect())
    assert set(copies) <= {r["doc_id"] for r in stages[3].collect()} and max(copies.values()) <= 3
    ends = Counter(r["doc_id"] for r in stages[5].collect() if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == copies


def test_run_leaves_the_last_table_alone(spark):
    """What a stage wrote goes once the next stage is written; the given documents stay."""
    import corpus_pipeline
    from tessera.llm.base import shared_dir

    stages = {name for name, _ in corpus_pipeline.STAGES}
    before = spark.read.parquet(f"{DATA}/documents.parquet").count()
    pieces = corpus_pipeline.run(spark, DATA)
    assert pieces.count() and spark.read.parquet(f"{DATA}/documents.parquet").count() == before
    root = shared_dir(spark).removeprefix("file://")
    left = [f.name for f in __import__("pathlib").Path(root).glob("*/pipeline-*")]
    assert [n.removeprefix("pipeline-").rsplit("-", 1)[0] for n in left] == ["packing"] and "packing" in stages
