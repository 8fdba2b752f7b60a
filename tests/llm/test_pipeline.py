import pytest

import corpus_pipeline as cp
from tests.llm.test_decontamination import brute as item_distance
from tests.llm.test_line_dedup import brute as without_boilerplate
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tranche.llm import decontamination, line_dedup, queries, toxicity
from tranche.llm.common import written_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before the first and after each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in cp.STAGES:
        docs = written_once(stage(spark, docs, sf_dir), "test-stage")
        out.append((docs.columns, docs.collect()))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near-duplicates", "benchmark decontamination", "piece encoding"]
    assert all(columns == COLUMNS for columns, _ in stages[1:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    assert sorted(map(tuple, stages[1][1])) == sorted(tuple(r) for r in stages[0] if scorer.score(r["text"]) < 0.7)
    assert len(stages[1][1]) < len(stages[0])


def test_boilerplate_lines_go(stages):
    before = [(r["doc_id"], r["text"], r["source"]) for r in stages[1][1]]
    expected = sorted(r[:2] for r in without_boilerplate(before, line_dedup.SITES))
    assert sorted((r["doc_id"], r["text"]) for r in stages[2][1]) == expected
    assert sum(len(r["text"]) for r in stages[2][1]) < sum(len(r["text"]) for r in stages[1][1])


def test_one_near_copy_stays(stages):
    groups = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in stages[2][1]])
    assert sorted(r["doc_id"] for r in stages[3][1]) == sorted(i for i, _, c in groups if i == c)
    assert len(stages[3][1]) < len(stages[2][1])


def test_documents_with_items_go(spark, sf_dir, stages):
    items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in stages[4][1]}
    for r in stages[3][1]:
        text = decontamination.normal(r["text"])
        exact = any(i in text for i in items)
        # Brute force on all pairs takes too long: the pieces of an item with k edits are k + 1, so one is exact.
        near = any(
            any(p in text for _, p in decontamination.pieces(i, decontamination.budget(len(i), 0.05)))
            and item_distance(i, text)[0] <= decontamination.budget(len(i), 0.05)
            for i in items
        )
        assert (r["doc_id"] not in kept) == (exact or near)


def test_pieces_restore_the_texts(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4][1]}
    last = stages[5][1]
    assert sorted(r["doc_id"] for r in last) == sorted(texts)
    assert all(r["restored"] and r["n_pieces"] == len(r["pieces"]) for r in last)


def test_run_applies_all_stages(spark, sf_dir, stages):
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1][1]))


def test_queries_are_registered():
    names = list(queries.queries())
    assert {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 11))
    assert set(queries.checks()) <= set(names)
