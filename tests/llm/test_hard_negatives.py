import numpy as np
import pytest

from tranche.llm import hard_negatives as hn


def brute(rows):
    """All anchors against all rows, by the contract's words."""
    kept = set()
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.add((vec_id, label, tuple(int(np.floor(np.float64(np.float32(x)) * 256)) for x in vector)))
    kept = sorted(kept)
    width = max([len(q) for _, _, q in kept], default=0)
    score = lambda a, b: sum(x * y for x, y in zip(a + (0,) * (width - len(a)), b + (0,) * (width - len(b))))
    out = []
    for a_id, a_label, a_q in kept:
        if a_id % 50:
            continue
        same = sorted((-score(a_q, q), i) for i, l, q in kept if l == a_label and i != a_id)[:5]
        for neg_p, p_id in same:
            p = -neg_p
            window = sorted((-score(a_q, q), i) for i, l, q in kept if l != a_label and 50 * p <= 100 * score(a_q, q) <= 95 * p)[:3]
            out += [(a_id, p_id, k + 1, n_id, p, -neg_n) for k, (neg_n, n_id) in enumerate(window)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("extra", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))


def random_rows(seed, n=400, d=6, classes=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(classes)), [float(x) for x in rng.normal(0.3, 1, d)]) for i in range(n)]
    rows += [(0, rows[0][1], rows[0][2]), (1000, None, [1.0] * d), (1001, 1, None), (1002, 1, [float("nan")] * d), (1003, 1, [None] * d), (None, 1, [1.0] * d)]
    rows += [(1050, 1, [0.5] * d), (1100, 1, [0.5] * d), (1150, 2, [0.25] * d), (1200, 2, [0.25] * d), (1250, 2, [])]  # ties, an empty vector
    return rows


@pytest.mark.parametrize("groups, blocks", [(20_000, 1_000), (37, 2)])
def test_equals_brute_force(spark, monkeypatch, groups, blocks):
    monkeypatch.setattr(hn, "ROWS_PER_GROUP", groups)
    monkeypatch.setattr(hn, "ANCHORS_PER_BLOCK", blocks)
    rows = random_rows(5)
    got = sorted(tuple(r) for r in hn.mine(table(spark, rows).withColumnRenamed("extra", "q")).collect())
    assert got == brute(rows) and got


def test_kernel_prunes_exactly():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-60, 60, (40, 64)), rng.integers(-60, 60, (300, 64))
    t = rng.normal(0, 4000, 40)
    ai, yi, sc = hn.threshold_pairs(x, t, y, np.ones((40, 300), bool))
    full = x @ y.T
    want = set(zip(*np.nonzero(full >= t[:, None])))
    assert set(zip(ai.tolist(), yi.tolist())) == want
    assert (sc == full[ai, yi]).all()


def test_large_components_stay_exact():
    x = np.array([[2**40, 1]], np.int64)
    y = np.array([[2**20, 3], [1, 1]], np.int64)
    ai, yi, sc = hn.threshold_pairs(x, np.array([0.0]), y, np.ones((1, 2), bool))
    assert sorted(sc.tolist()) == [2**40 + 1, 2**60 + 3]


def test_empty_and_all_invalid(spark):
    assert hn.mine(table(spark, [(50, None, [1.0])])).count() == 0
    assert hn.mine(table(spark, []).limit(0)).count() == 0
