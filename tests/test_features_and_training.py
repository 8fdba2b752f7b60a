import math

import numpy as np
import pytest
from frames import frame
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tranche import contracts
from tranche.operators import evaluation, features, training
from tranche.sources import storage


@pytest.fixture(scope="module")
def planted(spark):
    """Outcome driven by x: every model must rank better than chance."""
    noise = (F.xxhash64("id") % 1000) / 1000.0
    x = (F.col("id") % 100) / 100.0
    return spark.range(1200).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"),
        x.alias("x"),
        noise.alias("z"),
        F.when(F.col("id") % 3 == 0, "red").otherwise("blue").alias("colour"),
        (x + 0.3 * noise > 0.6).cast("bigint").alias("target_default"),
    )


def test_log_and_weights(spark):
    df = frame(spark, "a double, b double", (0.0, 4.0), (None, 9.0))
    assert [r.a for r in features.log1p(df, ["a"]).collect()] == [0.0, None]
    assert [r.w for r in features.with_weights(df, "b", "sqrt", "w").collect()] == [2.0, 3.0]
    for broken in (lambda: features.log1p(frame(spark, "a double", (-2.0,)), ["a"]), lambda: features.with_weights(df, "a")):
        with pytest.raises(Exception, match="negative"):
            broken().collect()
    with pytest.raises(ValueError):
        features.with_weights(df, "b", "cube")


def test_one_hot_uses_train_categories(spark):
    train = frame(spark, "c string", ("b",), ("a",), (None,))
    lists = features.category_lists(train, ["c"])
    assert lists == {"c": ["a", "b"]}
    rows = features.one_hot(frame(spark, "c string", ("a",), ("zzz",), (None,)), lists).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, False), (False, False)]
    assert [(r.position, r.category) for r in features.category_table(train, ["c"]).orderBy("position").collect()] == [(1, "a"), (2, "b")]


def test_medians(spark):
    train = frame(spark, "a double, e double", (1.0, None), (2.0, None), (3.0, None), (4.0, None), (None, None))
    assert features.fit_medians(train, ["a"]) == {"a": 2.5}
    assert features.features_to_impute(train) == ["a", "e"]
    with pytest.raises(contracts.ContractViolation):
        features.fit_medians(train, ["a", "e"])
    assert [r.a for r in features.impute(train, {"a": 2.5}).collect()][-1] == 2.5


def test_branches(spark):
    df = frame(spark, "row_id bigint, split string, amount double, c string, target_default bigint",
               (1, "train", 3.0, "x", 0), (2, "train", 8.0, "y", 1), (3, "train", None, "x", 0), (4, "test", None, "q", 1))
    rules = features.FeatureRules(log=["amount"], categorical=["c"], numeric=["amount"])
    parts = features.branches(df, rules)
    shared = {r.row_id: r for r in parts["shared"].collect()}
    assert shared[4].amount == pytest.approx((math.log1p(3) + math.log1p(8)) / 2) and not shared[4].c_x
    assert {r.row_id: r.amount for r in parts["tree_no_log"].collect()}[3] == 5.5
    assert parts["native"].filter("amount IS NULL").count() == 2
    with pytest.raises(contracts.ContractViolation):
        features.branches(df.withColumn("stray", F.lit(1)), rules)


def test_standardise_uses_population_deviation(spark):
    df = frame(spark, "split string, x double, c double", ("train", 1.0, 5.0), ("train", 3.0, 5.0), ("test", 5.0, 6.0))
    rows = training.standardise(df, ["x", "c"]).collect()
    assert [(r.x, r.c) for r in rows] == [(-1.0, 0.0), (1.0, 0.0), (3.0, 1.0)]


def test_holdout_is_exact_per_class_and_repeatable(planted):
    parts = training.stratified_holdout(planted, ["row_id"], share=0.25, seed=7)
    rows = parts.groupBy("target_default").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_holdout").alias("h")).collect()
    assert all(r.h == math.floor(r.n * 0.25 + 0.5) for r in rows)
    again = training.stratified_holdout(planted.repartition(5), ["row_id"], share=0.25, seed=7)
    first = {r.row_id for r in parts.filter("is_holdout").collect()}
    assert first == {r.row_id for r in again.filter("is_holdout").collect()}
    other = training.stratified_holdout(planted, ["row_id"], share=0.25, seed=8)
    assert first != {r.row_id for r in other.filter("is_holdout").collect()}


def test_models_learn_and_round_trip(spark, planted, tmp_path):
    train = planted.filter("split = 'train'")
    fits = {
        "lr": training.logistic_regression(train, ["x", "z"], max_iter=50),
        "rf": training.random_forest(train, ["x", "z"], trees=10, max_depth=5),
        "gbt": training.boosted_trees(train, ["x", "z", "colour"], categorical=["colour"], iterations=3, depth=3),
    }
    for name, (model, _) in fits.items():
        scored = training.score(model, planted, model_name=name)
        areas = {r.dataset_name: r.roc_auc for r in evaluation.classification_metrics(scored).collect()}
        assert areas["test"] > 0.9, name
    assert fits["lr"][1]["converged"]
    path = str(tmp_path / "model")
    storage.save_model(spark, fits["rf"][0], path, {"selected_model": "rf"})
    model, metadata, missing = storage.load_model(spark, path)
    assert metadata.first().row_identifier == "row_id" and "target_column" in missing and "selected_model" not in missing
    same = training.score(model, planted).select("row_id", F.col("predicted_probability").alias("p"))
    joined = same.join(training.score(fits["rf"][0], planted), "row_id")
    assert joined.filter(F.abs(F.col("p") - F.col("predicted_probability")) > 1e-12).count() == 0


def test_models_score_in_a_session_that_made_an_observation(planted):
    seen = Observation()
    planted.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 1200
    train = planted.filter("split = 'train'")
    for model, _ in (training.logistic_regression(train, ["x", "z"], max_iter=50), training.random_forest(train, ["x", "z"], trees=3, max_depth=3)):
        assert training.score(model, planted).filter("predicted_probability BETWEEN 0 AND 1").count() == 1200


def test_training_contracts(planted):
    one_class = planted.filter("target_default = 1")
    with pytest.raises(contracts.ContractViolation):
        training.logistic_regression(one_class, ["x"])
    with pytest.raises(contracts.ContractViolation, match="nulls"):
        training.random_forest(planted.withColumn("x", F.when(F.col("x") > 0.5, F.col("x"))), ["x"], trees=2)
    with pytest.raises(ValueError):
        training.boosted_trees(planted, ["x"], categorical=["colour"])


def test_search_draws_are_seeded_and_in_range():
    draws = training.draw_trials(5, 42)
    assert draws == training.draw_trials(5, 42) and draws != training.draw_trials(5, 43)
    assert all(300 <= d["iterations"] <= 800 and 4 <= d["depth"] <= 8 and 0.02 <= d["learning_rate"] < 0.15 for d in draws)
    assert all(isinstance(d["border_count"], int) for d in draws) and np.isfinite([d["l2_leaf_reg"] for d in draws]).all()
