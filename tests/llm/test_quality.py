import numpy as np

from tests.llm.rows import TEXTS, documents, empty
from tranche.llm import quality


def walk(trees, row):
    total = trees.start
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_are_walked_as_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, len(quality.NAMES)))
    x[:, 3] = np.round(x[:, 3])
    y = ((x[:, 0] > 0) & (x[:, 1] > -0.5) | (x[:, 3] > 1)).astype(float)
    trees = quality.grow(x[:600], y[:600], rounds=60)
    scores = trees.score(x)
    assert np.allclose(scores[:50], [walk(trees, row) for row in x[:50]])
    assert ((scores[600:] >= 0.5) == y[600:]).mean() > 0.9


def test_one_label_or_no_row_gives_a_share():
    x = np.ones((20, len(quality.NAMES)))
    assert np.allclose(quality.grow(x, np.ones(20)).score(x), 20.5 / 21)
    none = quality.grow(x[:0], np.zeros(0))
    assert np.allclose(none.score(x), 0.5)


def test_statistics_of_awkward_texts():
    for _, text in TEXTS:
        row = quality.statistics(text)
        assert len(row) == len(quality.NAMES) and np.isfinite(row).all()
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.NAMES)


def test_held_out_accuracy(spark):
    """Learnt on the training rows of the given tables, right on those that were held out."""
    from pyspark.sql import functions as F

    from tranche.llm.common import training_fold

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = quality.fit(docs, labels)
    held = quality.scores(docs, trees).join(labels, "doc_id").where(~training_fold())
    right = held.select(F.avg(((F.col("score") >= 0.5) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.95
    again = quality.fit(docs.repartition(7), labels)
    assert np.array_equal(trees.threshold, again.threshold) and np.array_equal(trees.value, again.value)


def test_awkward_rows_and_empty_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    trees = quality.fit(docs, labels)
    assert quality.scores(docs, trees).count() == len(TEXTS)
    assert quality.scores(empty(spark), trees).count() == 0
    assert quality.fit(empty(spark), labels.limit(0)).roots.size == 0
