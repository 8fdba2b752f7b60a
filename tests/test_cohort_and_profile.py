import pytest
from frames import frame
from pyspark.sql import functions as F

from tranche.operators import cohort, drift, figures, profile


@pytest.fixture(scope="module")
def sides(spark):
    train = frame(spark, "a bigint, b string, only_train string, empty double, fixed bigint, num string",
                  (1, " x ", "p", None, 5, "1"), (2, "y", "q", None, 5, "2.5"), (2, None, "q", None, 5, None))
    test = frame(spark, "a double, b string, only_test double, empty double, fixed bigint, num string",
                 (1.5, "x", 1.0, None, 5, "3"), (None, "z", 2.0, None, 5, "4"))
    return train, test


def test_inspect(sides):
    got = {r.column_name: r for r in profile.inspect(sides[0]).collect()}
    assert (got["b"].n_unique, got["b"].null_percent, got["b"].is_object) == (3, 33.33, True)
    assert got["empty"].is_fully_null and not got["empty"].is_constant
    assert got["fixed"].is_constant and got["num"].is_numeric_object and not got["b"].is_numeric_object


def test_audits(sides):
    strings = {r.column_name: r for r in profile.audit_strings(sides[0], 1).collect()}
    assert strings["b"].sample_values == ["x"] and strings["b"].unique_count_non_null == 2
    numbers = {r.column_name: r for r in profile.audit_numbers(sides[0]).collect()}
    assert (numbers["a"].median, numbers["a"].unique_count_non_null) == (2.0, 2)
    assert numbers["empty"].mean is None and numbers["empty"].median is None
    assert numbers["a"].std == pytest.approx(0.57735026919)
    with pytest.raises(ValueError):
        profile.audit_strings(sides[0], 0)


def test_numeric_audit_computes_its_input_once(spark):
    df = frame(spark, "a bigint, b double", (1, 2.0), (2, None)).filter("a <> 987654321")
    audit = profile.audit_numbers(df)
    assert "987654321" not in audit._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.column_name, r.median, r.unique_count_including_null, r.null_percent) for r in audit.collect()} == {("a", 1.5, 2, 0.0), ("b", 2.0, 2, 50.0)}


def test_residual_text_flags(spark):
    df = frame(spark, "a string, b string, c string", ("12-3.4", "x", None), ("7%", "y", None))
    got = {r.column_name: r for r in profile.residual_text(df, "train").collect()}
    assert got["a"].suspicious_numeric_like_text and not got["b"].suspicious_numeric_like_text
    assert got["c"].sample_values == "no non-missing values"


def test_structure_and_issues(sides):
    issues = {(r.column_name, r.issue, r.applies_to) for r in drift.structural_issues(drift.feature_universe(*sides)).collect()}
    assert ("only_train", "Present in train only", "train") in issues and ("a", "Dtype mismatch", "both") in issues
    assert ("empty", "100% Null", "test") in issues and ("fixed", "Constant", "train") in issues
    assert ("a", "High Missing (>50%)", "test") in issues
    queue = drift.decision_queue(drift.structural_issues(drift.feature_universe(*sides))).first()
    assert queue.issue == "Present in train only" and queue.recommended_action.startswith("Drop ingestion")


def test_drift_of_equal_frames_is_empty(sides):
    same = drift.string_drift_report(sides[0], sides[0])
    assert same["deltas"].count() == 0 and same["value_differences"].count() == 0
    assert drift.numeric_drift_report(sides[0], sides[0])["summary"].first().numeric_cols_with_differences == 0


def test_drift_report_exports(spark, sides, tmp_path):
    report = drift.string_drift_report(*sides, export_dir=str(tmp_path), tag="t")
    differences = {(r.column_name, r.value, r.present_in) for r in report["value_differences"].collect()}
    assert ("b", "y", "train_only") in differences and ("b", "z", "test_only") in differences
    assert not [d for d in differences if d[1] == "x"]
    assert (tmp_path / "string_alignment_t_deltas.csv").exists()
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "string_alignment_t_top_deltas.csv"))
    assert back.filter("column_name = 'b'").first().sample_values_train == '["x","y"]'


def test_skewness_matches_the_corrected_moment(spark):
    import pandas as pd

    values = [1.0, 2.0, 2.0, 3.0, 10.0, 40.0]
    df = frame(spark, "x double, c double", *[(v, 1.0) for v in values])
    got = {r.feature_name: r.skewness for r in profile.skewness_summary(df, ["x", "c"]).collect()}
    assert got["x"] == pytest.approx(pd.Series(values).skew()) and got["c"] == 0.0


def test_quantile_rates_need_three_edges(spark):
    df = frame(spark, "split string, x double, target_default bigint", *[("train", 1.0, 0)] * 5, ("test", 1.0, 1))
    with pytest.raises(Exception, match="too few distinct edges"):
        cohort.rate_by_train_quantile(df, "x").collect()


def test_quantile_rates_keep_empty_bins_and_drop_outside_rows(spark):
    train = [("train", float(i), i % 2) for i in range(1, 11)]
    df = frame(spark, "split string, x double, target_default bigint", *train, ("test", 0.5, 1), ("test", 10.0, 1), ("test", None, 1))
    rows = cohort.rate_by_train_quantile(df, "x", bins=5).orderBy("dataset_split", "bin").collect()
    test = [(r.bin, r.loan_count, r.default_rate_percent) for r in rows if r.dataset_split == "test"]
    assert test == [(1, 0, None), (2, 0, None), (3, 0, None), (4, 0, None), (5, 1, 100.0)]
    assert [r.loan_count for r in rows if r.dataset_split == "train"] == [2, 2, 2, 2, 2]


def test_category_rates_and_year_tables(spark):
    df = frame(spark, "split string, issue_year bigint, c string, loan_status string, target_default bigint",
               ("train", 2014, None, "fully_paid", 0), ("train", 2014, "a", "charged_off", 1), ("test", 2015, "a", "fully_paid", 0))
    rates = {(r.dataset_split, r.category): r.default_rate_percent for r in cohort.rate_by_category(df, "c").collect()}
    assert rates == {("train", "missing"): 0.0, ("train", "a"): 100.0, ("test", "a"): 0.0}
    table = cohort.status_by_year(df, ["fully_paid", "charged_off"]).collect()
    assert sum(r.fully_paid + r.charged_off for r in table) == 3
    assert cohort.with_target(df.drop("target_default")).filter("target_default = 1").count() == 1
    shares = profile.status_shares(df)
    assert {r.loan_status: r.percentage for r in shares.collect()} == {"fully_paid": 66.67, "charged_off": 33.33}


def test_histogram_counts_everything(spark):
    df = frame(spark, "x double, y double", (0.0, 3.0), (1.0, 3.0), (9.9, 3.0), (10.0, None))
    rows = figures.histogram(df, ["x", "y"], 10).collect()
    assert [r["count"] for r in rows if r.column_name == "x"] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    assert sum(r["count"] for r in rows if r.column_name == "y") == 3
    with pytest.raises(Exception, match="negative value in x"):
        figures.log_histograms(frame(spark, "x double", (-1.0,)), ["x"]).collect()


def test_group_coverage(spark):
    df = frame(spark, "a bigint, b bigint, c bigint", (1, None, 3))
    parts = drift.group_coverage(df, {"g": ["a", "zz"], "h": ["a", "b"]})
    assert [tuple(r) for r in parts["coverage_summary"].collect()] == [("g", 2, 1, 1, 1), ("h", 2, 2, 0, 1)]
    assert [r.feature_name for r in parts["duplicate_grouped_columns"].collect()] == ["a"]
    assert [r.feature_name for r in parts["ungrouped_columns"].collect()] == ["c"]


def test_model_feature_audit_refuses_other_order(spark):
    df = frame(spark, "a bigint, t bigint, f boolean", (1, 0, True), (2, 1, False))
    kinds = {r.feature_name: (r.feature_group, r.is_binary) for r in drift.model_feature_audit(df, df, "t").collect()}
    assert kinds == {"a": ("numeric", True), "f": ("boolean", True)}
    with pytest.raises(ValueError):
        drift.model_feature_audit(df, df.select("f", "a", "t"), "t")
