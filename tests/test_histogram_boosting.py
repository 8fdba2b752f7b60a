import numpy as np
import pytest
from pyspark.sql import functions as F

from tranche.operators import histogram_boosting as hb


def table(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x1, x2, x3 = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.normal(size=n)
    logit = 1.5 * x1 - 0.8 * (x2 > 2) + 0.3 * x3
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)
    w = rng.uniform(0.5, 2.0, n)
    rows = [(float(a) if i % 17 else None, float(b), float(c), int(t), float(v)) for i, (a, b, c, t, v) in enumerate(zip(x1, x2, x3, y, w))]
    return spark.createDataFrame(rows, "x1 double, x2 double, x3 double, y int, w double")


def brute(pdf, model, features, iterations, rate, depth, l2, weighted):
    """The same trees by direct sums over rows for every candidate split: no histograms, no Spark."""
    bins = np.stack([
        np.where(pdf[f].isna(), len(model.borders[j]) + 1, (pdf[f].to_numpy()[:, None] > np.array(model.borders[j])[None, :]).sum(axis=1) if model.borders[j] else 0)
        for j, f in enumerate(features)
    ], axis=1)
    y = pdf["y"].to_numpy(float)
    w = pdf["w"].to_numpy(float) if weighted else np.ones(len(y))
    f = np.full(len(y), model.base)
    trees = []
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-f))
        g, h = w * (p - y), w * p * (1 - p)
        leaf = np.zeros(len(y), int)
        levels = []
        for level in range(depth):
            best = None
            for j in range(len(features)):
                for s in range(len(model.borders[j]) + 1):
                    right = bins[:, j] > s
                    gain, ok = 0.0, False
                    for node in range(1 << level):
                        at = leaf == node
                        gl, hl = g[at & ~right].sum(), h[at & ~right].sum()
                        gr, hr = g[at & right].sum(), h[at & right].sum()
                        gain += gl**2 / (hl + l2) + gr**2 / (hr + l2) - (gl + gr) ** 2 / (hl + hr + l2)
                        ok |= hl > 0 and hr > 0
                    if ok and (best is None or gain > best[0] + 1e-9):
                        best = (gain, j, s)
            if best is None:
                break
            levels.append((best[1], best[2]))
            leaf = leaf + (bins[:, best[1]] > best[2]) * (1 << level)
        values = [-rate * g[leaf == k].sum() / (h[leaf == k].sum() + l2) for k in range(1 << len(levels))]
        trees.append((levels, values))
        f = f + np.array(values)[leaf]
    return trees


@pytest.mark.parametrize("weighted", [False, True])
def test_trees_equal_brute_force(spark, weighted):
    df = table(spark)
    features = ["x1", "x2", "x3"]
    model = hb.fit(df, features, "y", "w" if weighted else None, iterations=3, learning_rate=0.3, depth=3, l2_leaf_reg=2.0, random_strength=0.0, border_count=8, checkpoint_every=2)
    want = brute(df.toPandas(), model, features, 3, 0.3, 3, 2.0, weighted)
    assert [t[0] for t in model.trees] == [t[0] for t in want]
    assert np.allclose([v for t in model.trees for v in t[1]], [v for t in want for v in t[1]])


def test_penalty_and_noise_change_the_trees(spark):
    df = table(spark)
    args = dict(iterations=3, learning_rate=0.3, depth=3, border_count=16)
    plain = hb.fit(df, ["x1", "x2", "x3"], "y", l2_leaf_reg=0.0, random_strength=0.0, **args)
    penalised = hb.fit(df, ["x1", "x2", "x3"], "y", l2_leaf_reg=50.0, random_strength=0.0, **args)
    noisy = hb.fit(df, ["x1", "x2", "x3"], "y", l2_leaf_reg=0.0, random_strength=5.0, **args)
    assert np.abs(penalised.trees[0][1]).max() < np.abs(plain.trees[0][1]).max()
    assert [t[0] for t in noisy.trees] != [t[0] for t in plain.trees]
    again = hb.fit(df, ["x1", "x2", "x3"], "y", l2_leaf_reg=0.0, random_strength=5.0, **args)
    assert [t[0] for t in again.trees] == [t[0] for t in noisy.trees]


def test_scores_follow_the_trees_and_learn(spark):
    df = table(spark, n=2000)
    model = hb.fit(df, ["x1", "x2", "x3"], "y", iterations=20, learning_rate=0.2, depth=3, random_strength=0.5)
    scored = hb.predict(model, df).toPandas()
    assert scored["predicted_probability"].between(0, 1).all()
    pos, neg = scored[scored.y == 1].predicted_probability.to_numpy(), scored[scored.y == 0].predicted_probability.to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.75
    assert hb.splits_table(model, spark).count() == sum(len(t[0]) for t in model.trees)


def test_constant_features_and_zero_weights(spark):
    df = table(spark).withColumn("c", F.lit(1.0)).withColumn("w", F.lit(None).cast("double"))
    model = hb.fit(df, ["c"], "y", iterations=2, depth=2)
    assert all(levels == [] for levels, _ in model.trees)
    zero = hb.fit(df, ["x1"], "y", "w", iterations=1, depth=2)
    assert zero.trees == [] or all(v == 0 for v in zero.trees[0][1])


def test_bins_are_found_by_halving(spark):
    borders = [float(b) for b in range(0, 254, 2)]
    values = [None, float("nan"), float("-inf"), float("inf"), -1.0, 0.0, 0.5, 2.0, 251.0, 252.0, 252.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for cut in (borders, borders[:1], borders[:2], borders[:64], []):
        got = [r.b for r in df.select(hb.binned(F.col("x"), cut).alias("b")).collect()]
        assert got == [len(cut) + 1 if v is None or v != v else sum(v > b for b in cut) for v in values]
    plan = df.select(hb.binned(F.col("x"), borders).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate([64,32,16,8,4,2,1]" in plan  # seven steps a value for 127 borders


def test_forests_grown_in_tasks_and_by_levels_are_the_same(spark, monkeypatch):
    df = table(spark, n=900).repartition(3).persist()
    common = {"learning_rate": 0.3, "l2_leaf_reg": 1.0}
    settings = [
        {"iterations": 25, "depth": 2, "border_count": 8, "random_strength": 1.0, **common},
        {"iterations": 4, "depth": 9, "border_count": 300, "random_strength": 0.0, **common},
    ]
    features = ["x1", "x2", "x3"]
    in_tasks = hb.fit_many(df, features, settings, "y", "w")
    monkeypatch.setattr(hb, "BLOCK_ROWS", 100)
    monkeypatch.setattr(hb, "MOST_PARTIALS", 2)
    monkeypatch.setattr(hb, "MOST_STEPS", 3)
    by_levels = hb.fit_many(df, features, settings, "y", "w", checkpoint_every=2, most_in_a_task=0)
    for setting, one, other in zip(settings, in_tasks, by_levels, strict=True):
        assert len(one.trees) == setting["iterations"] and all(len(levels) <= setting["depth"] for levels, _ in one.trees)
        assert (one.borders, one.trees, one.gains) == (other.borders, other.trees, other.gains)
    alone = hb.fit(df, features, "y", "w", iterations=4, learning_rate=0.3, depth=9, l2_leaf_reg=1.0, random_strength=0.0, border_count=300)
    assert (alone.borders, alone.trees) == (in_tasks[1].borders, in_tasks[1].trees)
    df.unpersist()


def test_many_forests_score_as_each_does(spark):
    df = table(spark, n=300)
    settings = [dict(iterations=k, learning_rate=0.3, depth=k, l2_leaf_reg=1.0, random_strength=0.0, border_count=4 * k) for k in (1, 3)]
    models = hb.fit_many(df, ["x1", "x2", "x3"], settings, "y")
    every = hb.predict_many(models, df, "number", "p").groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).collect()
    alone = [hb.predict(m, df, "p").agg(F.sum("p")).first()[0] for m in models]
    assert {r.number: r.n for r in every} == {0: 300, 1: 300}
    assert [r.p for r in sorted(every, key=lambda r: r.number)] == pytest.approx(alone, abs=1e-9)


def test_a_split_that_leaves_a_side_without_rows_is_not_taken(spark):
    rng = np.random.default_rng(5)
    rows = [(float(i % 2), *map(float, rng.normal(size=3)), int(t), float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 2, 500), rng.uniform(0.1, 3.0, 500)))]
    df = spark.createDataFrame(rows, "x double, a double, b double, c double, y int, w double")
    model = hb.fit(df, ["x", "a", "b", "c"], "y", "w", iterations=8, depth=4, random_strength=50.0)
    taken = {at for levels, _ in model.trees for at in levels}
    # Nothing is above the largest value of x, which is its last border, and no value of any feature is missing.
    assert taken and all(split < len(model.borders[feature]) - (model.borders[feature][-1] == 1.0) for feature, split in taken)
