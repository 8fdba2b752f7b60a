"""No row leaves silently, no cap changes a result: rows in are rows out, or the job fails and says why."""

import pytest
from pyspark.sql import functions as F

from tests.frames import frame
from tranche import contracts
from tranche.operators import cleaning, cohort, evaluation, features, figures, ordered, profile, training, validation
from tranche.sources import dirty_csv


def test_every_status_is_counted_or_refused(spark):
    df = frame(spark, "split string, issue_year bigint, loan_status string",
               ("train", 2014, "fully_paid"), ("train", 2014, "odd._status:x"), ("test", 2015, "late"), ("test", 2015, "late"))
    rows = [r.asDict() for r in cohort.status_by_year(df).collect()]
    assert sum(v for r in rows for k, v in r.items() if k not in ("dataset_split", "issue_year")) == 4
    with pytest.raises(Exception, match="unlisted status: late"):
        cohort.status_by_year(df, ["fully_paid", "odd._status:x"]).collect()


def test_unknown_subgrades_are_refused(spark):
    for name in ("h1", None):
        df = frame(spark, "split string, grade string, sub_grade string, loan_count bigint", ("train", "a", "a1", 1), ("train", "a", name, 7))
        with pytest.raises(Exception, match="unknown subgrade"):
            validation.subgrade_pivot(df).collect()


def test_row_ids_refuse_null_keys(spark):
    good = frame(spark, "split string, k bigint", ("train", 5), ("train", 2), ("test", 9))
    assert sorted(tuple(r) for r in cleaning.with_row_ids(good, "k").collect()) == [(1, "test", 9), (1, "train", 2), (2, "train", 5)]
    for row in (("train", None), (None, 7)):
        with pytest.raises(Exception, match="must not be null"):
            cleaning.with_row_ids(good.unionByName(frame(spark, "split string, k bigint", row)), "k").collect()


def test_other_splits_are_refused(spark):
    df = frame(spark, "split string, loan_status string, c string, v bigint", ("train", "a", "x", 1), ("holdout", "a", "x", 2))
    with pytest.raises(Exception, match="split must be"):
        profile.status_by_split(df).collect()
    with pytest.raises(Exception, match="unlisted split"):
        figures.split_pivot(df, "c", "v", split="split").collect()


def test_many_categories_become_columns_unless_a_limit_is_given(spark):
    df = spark.range(2100).select(F.concat(F.lit("c"), "id").alias("f"))
    assert len(features.category_lists(df, ["f"])["f"]) == 2100
    with pytest.raises(contracts.ContractViolation, match="too many categories"):
        features.category_lists(df, ["f"], most=2000)


def test_many_labels_have_their_own_bins(spark):
    df = spark.range(24_000).select((F.col("id") % 12_000).alias("label"), F.col("id").cast("double").alias("v"))
    edges = ordered.bin_edges(df, ["label"], "v", 2)
    binned = ordered.with_bin(df, edges, ["label"], "v", 2)
    assert binned.filter("bin is null").count() == 0 and binned.select("label").distinct().count() == 12_000


def test_alignment_is_one_to_one_or_fails(spark):
    schema = "split string, row_id bigint, loan_status string"
    clean = frame(spark, schema, ("train", 1, "fully_paid"), ("train", 2, "charged_off"), ("test", 1, "fully_paid"))
    modeled = clean.filter("split = 'train'").select("split", "row_id")
    assert validation.align_clean_rows(clean, modeled).count() == 2
    with pytest.raises(contracts.ContractViolation, match="unique_key"):
        validation.align_clean_rows(clean.unionByName(clean), modeled)
    with pytest.raises(contracts.ContractViolation, match="keys_missing_on_right"):
        validation.align_clean_rows(clean.filter("row_id = 1"), modeled)
    with pytest.raises(contracts.ContractViolation):
        validation.validation_dataset(modeled, clean, model=None)


def test_grade_slices_need_all_seven_grades(spark):
    rows = [("train", g, *[0.2] * 35) for g in "abcdefg"]
    schema = "split string, grade string, " + ", ".join(f"{s} double" for s in validation.SUBGRADES)
    assert figures.grade_slices(frame(spark, schema, *rows)).count() == 35
    for some in (rows[:6], [*rows, rows[0]]):
        with pytest.raises(contracts.ContractViolation, match="one row per split and grade"):
            figures.grade_slices(frame(spark, schema, *some))


def test_risk_bands_refuse_what_they_would_lose(spark):
    schema = "dataset_name string, predicted_default_probability double, target_default bigint, r double"
    good = [("test", i / 20, i % 2, None) for i in range(20)]
    assert evaluation.risk_bands(frame(spark, schema, *good), bands=4).agg(F.sum("loan_count")).first()[0] == 20
    with pytest.raises(Exception, match="must not be null"):
        evaluation.risk_bands(frame(spark, schema, *good, ("test", None, 1, None)), bands=4).collect()
    with pytest.raises(Exception, match="interest rates are all missing"):
        evaluation.risk_bands(frame(spark, schema, *good), bands=4, interest_rate="r").collect()


def test_options_without_a_counterpart_are_refused(spark):
    df = frame(spark, "x double, target_default bigint", *[(float(i), i % 2) for i in range(20)])
    for options in ({"max_depth": 31}, {"min_split": 10}, {"max_features": "some"}, {"class_weight": {1: 2.0}}):
        with pytest.raises(ValueError):
            training.random_forest(df, ["x"], trees=2, **options)
    with pytest.raises(ValueError):
        training.boosted_trees(df, ["x"], depth=40)
    with pytest.raises(ValueError):
        training.draw_trials(2, ranges={"leaves": (1, 2)})
    assert all(d["iterations"] in (2, 3) for d in training.draw_trials(9, ranges={"iterations": (2, 4)}))


def test_balanced_classes_move_the_intercept(spark):
    df = frame(spark, "x double, target_default bigint", *[(float(i % 3), int(i % 10 == 0)) for i in range(300)])
    plain, _ = training.logistic_regression(df, ["x"])
    even, _ = training.logistic_regression(df, ["x"], class_weight="balanced")
    score = lambda model: training.score(model, df).agg(F.avg("predicted_probability")).first()[0]
    assert abs(score(plain) - 0.1) < 0.01 and abs(score(even) - 0.5) < 0.01


def test_weights_come_from_the_raw_amount(spark, sf_dir):
    from tranche.plans.feature_queries import weighted_branch
    from tranche.plans.loans import modeled_loans, raw_loans

    weighted, names = weighted_branch(spark, sf_dir)
    raw = modeled_loans(raw_loans(spark, sf_dir)).select("split", "row_id", F.col("loan_amnt").alias("raw"))
    joined = weighted.join(raw, ["split", "row_id"])
    assert joined.count() == raw.count() and "sample_weight" not in names
    assert joined.filter(F.abs(F.col("sample_weight") - F.sqrt("raw")) > 1e-9).count() == 0


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    files = {
        "a.csv": '"Notes, by Prospectus"\n"id","name, full","n"\n1,"x, y",2\n',
        "b.csv": 'n,id,"name, full"\n3,4,z\nn,id,"name, full"\n',
        "c.csv": "5,w,6\n7,v,8\n",
        "d.csv": '"id","name, full","n"\n9,u,10\n',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    path = str(tmp_path)
    rows = dirty_csv.normalise(spark, path).select("source_file", "id", "`name, full`", "n").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("a.csv", "1", "x, y", "2"), ("b.csv", "4", "z", "3"), ("c.csv", "5", "w", "6"), ("c.csv", "7", "v", "8"), ("d.csv", "9", "u", "10"),
    ]
    counts = {r.source_file: tuple(r)[1:] for r in dirty_csv.normalisation_counts(spark, path).collect()}
    assert counts == {"a.csv": (3, 2, 1, 0, 0), "b.csv": (3, 2, 0, 1, 0), "c.csv": (2, 2, 0, 0, 0), "d.csv": (2, 2, 0, 0, 0)}
    (tmp_path / "e.csv").write_text("id,other,n\n1,2,3\n")
    with pytest.raises(contracts.ContractViolation, match="other columns"):
        dirty_csv.normalise(spark, path)
