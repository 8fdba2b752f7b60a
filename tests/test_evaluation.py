import math

import numpy as np
import pytest
from frames import BASELINE_POLICIES, CUTOFF_COUNTS, MATCHES, MODEL_POLICIES, SUBGRADE_AUC, SUBGRADE_COUNTS, frame, policy_table
from pyspark.sql import functions as F

from tranche.operators import evaluation, policy, validation


@pytest.fixture(scope="module")
def published(spark):
    """One row per loan of the published cohort, rebuilt from its counts."""
    counts = frame(spark, "sub_grade string, n bigint, d bigint", *SUBGRADE_COUNTS)
    rows = counts.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    return rows.select(
        "sub_grade", (F.col("i") <= F.col("d")).cast("bigint").alias("target_default"),
        F.lit(1000.0).alias("loan_amnt"), F.lit("test").alias("split"),
    )


def test_published_subgrade_auc(published):
    roc = evaluation.subgrade_roc(published)
    assert all(r.auc == pytest.approx(SUBGRADE_AUC, abs=1e-12) for r in roc.collect())


def test_published_cutoff_policies(published):
    got = [(r.policy_value, r.accepted_count, r.accepted_default_count) for r in policy.cutoff_sweep(published).orderBy("policy_value").collect()]
    assert got == CUTOFF_COUNTS


def test_published_matches(spark):
    model, baseline = policy_table(spark, MODEL_POLICIES, "double"), policy_table(spark, BASELINE_POLICIES, "string")
    matched = policy.match_by_acceptance(model, baseline)
    got = [(r.baseline_policy, r.model_threshold, r.net_value_with_opportunity_cost_diff) for r in matched.collect()]
    assert got == MATCHES
    top = policy.decision_points(matched, 1).first()
    assert top["Acceptance Rate"] == "37.4%" and top["Model Advantage"] == "$27,085,350"
    shown = policy.format_match(matched).first()
    assert shown.net_value_proxy_diff == "-$57,126,200" and shown.acceptance_rate_diff == "-7.70%"


def roc_frame(spark, y, p):
    return frame(spark, "y bigint, p double, system_name string, dataset_name string", *[(a, b, "s", "d") for a, b in zip(y, p, strict=True)])


def test_roc_with_ties(spark):
    rows = evaluation.roc_points(roc_frame(spark, [1, 0, 1, 0], [0.9, 0.9, 0.4, 0.1]), "y", "p").orderBy(F.desc("threshold")).collect()
    assert [(r.false_positive_rate, r.true_positive_rate) for r in rows] == [(0, 0), (0.5, 0.5), (0.5, 1), (1, 1)]
    assert math.isinf(rows[0].threshold) and rows[0].auc == pytest.approx(0.625)


def test_auc_equals_pairwise_count(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 400), rng.integers(0, 40, 400) / 40
    pos, neg = p[y == 1], p[y == 0]
    pairs = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    df = roc_frame(spark, y.tolist(), p.tolist())
    assert evaluation.auc(df, ["system_name"], "y", "p").first().auc == pytest.approx(pairs / (len(pos) * len(neg)))
    monotone = df.withColumn("p", F.exp("p") * 3)
    assert evaluation.auc(monotone, ["system_name"], "y", "p").first().auc == pytest.approx(pairs / (len(pos) * len(neg)))


def test_roc_refuses_one_class_nulls_and_other_targets(spark):
    for y, p, words in (([1, 1], [0.1, 0.2], "both classes"), ([0, None], [0.1, 0.2], "must be 0 or 1"), ([0, 2], [0.1, 0.2], "must be 0 or 1"), ([0, 1], [0.1, None], "must not be null")):
        with pytest.raises(Exception, match=words):
            evaluation.roc_points(roc_frame(spark, y, p), "y", "p").collect()


def test_collinear_points_are_dropped(spark):
    df = roc_frame(spark, [0, 1, 0, 1, 0, 1], [0.9, 0.9, 0.8, 0.8, 0.7, 0.7])
    assert evaluation.roc_points(df, "y", "p").count() == 3
    assert evaluation.roc_points(df, "y", "p", drop_collinear=False).count() == 4


def test_metrics_and_zero_division(spark):
    df = frame(spark, "target_default bigint, p double, loan_amnt double, model_name string, dataset_name string",
               (1, 0.2, 10.0, "m", "d"), (0, 0.1, 20.0, "m", "d"), (0, 0.3, 30.0, "m", "d"))
    scored = evaluation.with_predictions(df, "p")
    row = evaluation.classification_metrics(scored).first()
    assert (row.precision, row.recall, row.f1, row.true_negative, row.false_negative) == (0, 0, 0, 2, 1)
    assert row.accuracy == pytest.approx(2 / 3) and row.roc_auc == pytest.approx(0.5)
    outcomes = {r.outcome_type: (r.row_count, r.median_loan_amnt) for r in evaluation.outcome_summary(evaluation.row_outcomes(scored)).collect()}
    assert outcomes == {"true_negative": (2, 25.0), "false_negative": (1, 10.0)}
    # Published confusion cells of the logistic regression give its published accuracy and F1.
    tn, fp, fn, tp = 47482, 1362, 9962, 1206
    assert (tp + tn) / (tp + tn + fp + fn) == pytest.approx(0.8113044057855096)
    assert 2 * tp / (2 * tp + fp + fn) == pytest.approx(0.17559697146185207)


def test_policy_extremes(spark):
    df = frame(spark, "target_default bigint, p double, loan_amnt double, split string", (1, 0.9, 10.0, "test"), (0, 0.8, 5.0, "test"))
    rows = {r.policy_value: r for r in policy.threshold_sweep(df, [0.5, 1.0], score="p").collect()}
    none, every = rows[0.5], rows[1.0]
    assert (none.accepted_count, none.default_rate_among_accepted, none.rejected_loan_amnt) == (0, 0.0, 15.0)
    assert (every.accepted_count, every.rejected_count, every.default_rate_among_accepted) == (2, 0, 0.5)
    one = policy.policy_outcomes(policy.threshold_policy(df, 0.85, "p"), "t", 0.85).first()
    cells = one.accepted_default_count + one.accepted_non_default_count + one.rejected_default_count + one.rejected_non_default_count
    assert cells == one.row_count == 2
    with pytest.raises(ValueError):
        policy.threshold_policy(df, 1.5, "p")
    broken = policy.threshold_policy(df, 0.85, "p").withColumn("rejected_flag", F.lit(1))
    with pytest.raises(Exception, match="complementary"):
        policy.policy_outcomes(broken, "t", 0.85).collect()


def test_exception_pricing_without_exceptions(spark):
    df = frame(spark, "target_default bigint, loan_status string, p double, int_rate double, loan_amnt double, split string",
               (1, "Does_Not_Meet_The_Credit_Policy._status:charged_off", 0.4, 14.0, 100.0, "train"), (0, "fully_paid", 0.2, 10.0, 300.0, "train"),
               (0, "fully_paid", 0.3, 12.0, 200.0, "test"))
    summary = policy.exception_pricing(df, score="p")
    comparison = {r.dataset_name: r for r in policy.exception_comparison(summary).collect()}
    assert comparison["test"].row_count_policy_exception_issued is None and comparison["test"].default_rate_gap is None
    assert comparison["train"].int_rate_median_gap == 4.0
    shown = policy.format_exception_comparison(policy.exception_comparison(summary)).orderBy("dataset_name").collect()
    assert shown[1].default_rate_gap == "100.00%" and shown[0].default_rate_gap is None


def test_subgrade_tables(spark, published):
    distribution = validation.subgrade_distribution(published.withColumn("grade", F.substring("sub_grade", 1, 1)))
    shares = validation.normalised_pivot(validation.subgrade_pivot(distribution))
    for row in shares.collect():
        assert sum(row[s] for s in validation.SUBGRADES) == pytest.approx(1.0)
    with pytest.raises(Exception, match="unknown subgrade: h1"):
        evaluation.with_subgrade_rank(frame(spark, "sub_grade string", ("h1",))).collect()
    rates = validation.ordered_subgrades(validation.default_rate_by_subgrade(published))
    assert [r.sub_grade for r in rates.collect()] == validation.SUBGRADES
    with pytest.raises(Exception, match="repeated split"):
        validation.subgrade_pivot(distribution.unionByName(distribution)).collect()


def test_calibration_and_bands_cover_all_rows(spark):
    df = spark.range(200).select((F.col("id") % 7 == 0).cast("bigint").alias("target_default"), (F.col("id") / 200).alias("p"), (F.col("id") % 20 + 5.0).alias("rate"), F.lit("train").alias("dataset_name"))
    table = evaluation.calibration_table(df.withColumn("system_name", F.lit("m")), score="p").collect()
    assert [r.bin_order for r in table] == list(range(1, 11)) and sum(r.row_count for r in table) == 200
    bands = evaluation.risk_bands(df, score="p", interest_rate="rate").collect()
    assert sum(b.loan_count for b in bands) == 200 and all(0.05 <= b.int_rate_mean <= 0.25 for b in bands)
