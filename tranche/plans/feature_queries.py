"""Catalogue: features (F), model fits (M) and model storage (A12, A14).

Fits run on the whole modeled train split. The linear fits have the library's defaults, which are the
published settings, and so have the histogram trees (500 rounds of 6 levels; 25 trials of 300 to 800 rounds). Spark's
own forests, boosting and search are fitted smaller here, as 300 deep trees, 500 rounds and 25 trials take hours on
one machine; their settings stand below and are arguments of the operators.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tranche.functions.shape import local_table, record, rows_of
from tranche.operators import drift, evaluation, features, histogram_boosting, target_statistics, training, validation
from tranche.plans.loans import clean_loans, modeled_loans, raw_loans, stored_loans, train_of
from tranche.plans.registry import check, query, r, rounded
from tranche.plans.session import shared_folder, written_once
from tranche.sources import storage

RULES = features.FeatureRules(
    log=["annual_inc", "loan_amnt", "revol_bal"],
    categorical=["purpose", "home_ownership"],
    binary=["has_mths_since_last_delinq"],
    numeric=[
        "annual_inc", "loan_amnt", "revol_bal", "dti", "open_acc", "emp_length_years", "term_months",
        "mths_since_last_delinq",
    ],
    dropped=["loan_status", "issue_d", "issue_year", "pymnt_plan", "grade", "sub_grade", "int_rate", "score"],
)
TREES = 20
ITERATIONS = 5
TRIALS = 3
RANGES = {"iterations": (2, 5), "depth": (2, 5)}
TOLERANCE = 1e-3


def _modeled(spark, sf_dir):
    return modeled_loans(raw_loans(spark, sf_dir))


def _branches(spark, sf_dir):
    return features.branches(stored_loans(spark, sf_dir), RULES)


@query(
    "f1_log1p",
    check(
        f"""SELECT split, row_id, {r('ln(1 + loan_amnt)')} AS loan_amnt, {r('ln(1 + annual_inc)')} AS annual_inc,
            {r('ln(1 + revol_bal)')} AS revol_bal FROM m"""
    ),
)
def f1_log1p(spark, sf_dir):
    logged = features.log1p(_modeled(spark, sf_dir), ["loan_amnt", "annual_inc", "revol_bal"])
    return rounded(logged.select("split", "row_id", "loan_amnt", "annual_inc", "revol_bal"))


@query(
    "f2_category_lists",
    check(
        """SELECT feature_name, category, ROW_NUMBER() OVER (PARTITION BY feature_name ORDER BY category) AS position FROM (
           SELECT DISTINCT 'purpose' AS feature_name, purpose AS category FROM m WHERE split = 'train'
           UNION ALL SELECT DISTINCT 'home_ownership', home_ownership FROM m WHERE split = 'train')"""
    ),
)
def f2_category_lists(spark, sf_dir):
    return features.category_table(train_of(_modeled(spark, sf_dir)), ["purpose", "home_ownership"])


_HOMES = ["mortgage", "other", "own", "rent"]
_PURPOSES = ["automobile_goods", "building_goods", "furniture_goods", "household_goods", "machinery_goods"]
_ONE_HOT = ", ".join(
    [f"home_ownership = '{h}' AS home_ownership_{h}" for h in _HOMES] + [f"purpose = '{p}' AS purpose_{p}" for p in _PURPOSES]
)


@query("f3_one_hot", check(f"SELECT split, row_id, {_ONE_HOT} FROM m"))
def f3_one_hot(spark, sf_dir):
    modeled = _modeled(spark, sf_dir)
    lists = features.category_lists(train_of(modeled), ["home_ownership", "purpose"])
    return features.one_hot(modeled.select("split", "row_id", "home_ownership", "purpose"), lists)


_IMPUTED = ["dti", "revol_bal", "open_acc", "emp_length_years"]


@query(
    "f4_median_imputation",
    check(
        "SELECT split, row_id, "
        + ", ".join(
            f"{r(f'''COALESCE(CAST({c} AS DOUBLE), (SELECT MEDIAN(CAST({c} AS DOUBLE)) FROM m WHERE split = 'train'))''')} AS {c}" for c in _IMPUTED
        )
        + " FROM m"
    ),
)
def f4_median_imputation(spark, sf_dir):
    modeled = stored_loans(spark, sf_dir, "split", "row_id", *_IMPUTED)
    medians = features.fit_medians(train_of(modeled), _IMPUTED)
    return rounded(features.impute(modeled, medians).select("split", "row_id", *_IMPUTED))


@query(
    "f5_features_to_impute",
    check(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM m WHERE split = 'train' HAVING COUNT(*) > COUNT({c})"
            for c in RULES.numeric
        )
    ),
)
def f5_features_to_impute(spark, sf_dir):
    train = train_of(_modeled(spark, sf_dir)).select(*RULES.numeric)
    return features.null_counts(train).filter("null_count > 0")


def _filled(c: str, logged: bool) -> str:
    e = f"ln(1 + {c})" if logged and c in RULES.log else f"CAST({c} AS DOUBLE)"
    return f"{r(f'''COALESCE({e}, (SELECT MEDIAN({e}) FROM m WHERE split = 'train'))''')} AS {c}"


def _branch_sql(logged: bool) -> str:
    plain = ["has_mths_since_last_delinq", "CAST(term_months AS BIGINT) AS term_months", "mths_since_last_delinq"]
    values = [_filled(c, logged) for c in ("annual_inc", "loan_amnt", "revol_bal", "dti", "open_acc", "emp_length_years")]
    return f"SELECT split, row_id, target_default, {', '.join([*values, *plain])}, {_ONE_HOT} FROM m"


def _branch(df):
    wide = df.withColumn("term_months", F.col("term_months").cast("bigint"))
    return rounded(wide.withColumns({c: F.col(c).cast("double") for c in ("annual_inc", "loan_amnt")}))


@query("f6_shared_branch", check(_branch_sql(True)))
def f6_shared_branch(spark, sf_dir):
    return _branch(_branches(spark, sf_dir)["shared"])


@query("f6_tree_no_log_branch", check(_branch_sql(False)))
def f6_tree_no_log_branch(spark, sf_dir):
    return _branch(_branches(spark, sf_dir)["tree_no_log"])


@query(
    "f7_group_coverage",
    check(
        " UNION ALL ".join(
            f"""SELECT '{g}' AS feature_group, CAST({len(cs)} AS BIGINT) AS grouped_feature_count, CAST({len(cs)} AS BIGINT) AS present_feature_count,
            CAST(0 AS BIGINT) AS missing_feature_count, {' + '.join(f'COUNT({c})' for c in cs)} AS non_null_values FROM m"""
            for g, cs in (("binary", RULES.binary), ("categorical", RULES.categorical), ("dropped", RULES.dropped), ("numeric", RULES.numeric))
        )
    ),
)
def f7_group_coverage(spark, sf_dir):
    modeled = _modeled(spark, sf_dir)
    features.coverage_contract(modeled, RULES)
    groups = {"binary": RULES.binary, "categorical": RULES.categorical, "dropped": RULES.dropped, "numeric": RULES.numeric}
    return drift.group_coverage(modeled, groups)["coverage_summary"]


_BASE = [
    "row_id", "split", "loan_amnt", "annual_inc", "mths_since_last_delinq", "open_acc", "dti", "revol_bal",
    "has_mths_since_last_delinq", "term_months", "emp_length_years", "target_default",
]
_FLAGS = [f"purpose_{p}" for p in _PURPOSES] + [f"home_ownership_{h}" for h in _HOMES]
_NATIVE = _BASE[:4] + ["home_ownership", "purpose"] + _BASE[4:]


def _manifest_sql(branch: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{branch}' AS branch, CAST({i} AS BIGINT) AS position, '{c}' AS column_name,
        COUNT(*) - COUNT({c if branch == 'native' else '*'}) AS null_count FROM m"""
        for i, c in enumerate(names, start=1)
    )


@query(
    "f8_branch_manifest",
    check(
        " UNION ALL ".join(
            [_manifest_sql("shared", _BASE + _FLAGS), _manifest_sql("tree_no_log", _BASE + _FLAGS), _manifest_sql("native", _NATIVE)]
        )
    ),
)
def f8_branch_manifest(spark, sf_dir):
    return features.branch_manifest(_branches(spark, sf_dir))


@query(
    "f9_missing_totals",
    check(
        f"""SELECT b.branch, split AS dataset_split,
            CAST(SUM(CASE WHEN b.branch = 'native' THEN {' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in RULES.numeric)} ELSE 0 END) AS BIGINT) AS missing_values
            FROM m, (VALUES ('shared'), ('tree_no_log'), ('native')) b(branch) GROUP BY ALL"""
    ),
)
def f9_missing_totals(spark, sf_dir):
    return features.missing_totals(_branches(spark, sf_dir))


@query(
    "f10_sample_weights",
    check(
        f"""SELECT split, row_id, {r('SQRT(loan_amnt)')} AS weight_sqrt, {r('ln(1 + loan_amnt)')} AS weight_log,
            {r('loan_amnt')} AS weight_raw FROM m"""
    ),
)
def f10_sample_weights(spark, sf_dir):
    df = _modeled(spark, sf_dir)
    for method in features.WEIGHT_METHODS:
        df = features.with_weights(df, method=method, output=f"weight_{method}")
    return rounded(df.select("split", "row_id", *[f"weight_{m}" for m in features.WEIGHT_METHODS]))


_VECTOR = ["loan_amnt", "annual_inc", "mths_since_last_delinq"]


@query(
    "f11_feature_vector",
    check(
        f"""SELECT split, row_id, target_default, CAST(3 AS BIGINT) AS feature_count,
            {r('loan_amnt + annual_inc + mths_since_last_delinq', 4)} AS feature_sum FROM m"""
    ),
)
def f11_feature_vector(spark, sf_dir):
    vectors = features.assemble(_modeled(spark, sf_dir), _VECTOR)
    values = vector_to_array("features")
    return vectors.select(
        "split",
        "row_id",
        "target_default",
        F.size(values).cast("bigint").alias("feature_count"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 4).alias("feature_sum"),
    )


# --- fits -----------------------------------------------------------------------------------

_SCALED = ["loan_amnt", "annual_inc", "mths_since_last_delinq"]


@query(
    "m1_scaling",
    check(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature_name, {r(f'AVG({c})')} AS mean, {r(f'STDDEV_POP({c})')} AS scale FROM m WHERE split = 'train'"
            for c in _SCALED
        )
    ),
)
def m1_scaling(spark, sf_dir):
    return rounded(training.scaling(train_of(_modeled(spark, sf_dir)), _SCALED))


@query(
    "m1_standardise",
    check(
        "SELECT split, row_id, "
        + ", ".join(
            r(f"({c} - (SELECT AVG({c}) FROM m WHERE split = 'train')) / (SELECT STDDEV_POP({c}) FROM m WHERE split = 'train')") + f" AS {c}"
            for c in _SCALED
        )
        + " FROM m"
    ),
)
def m1_standardise(spark, sf_dir):
    return rounded(training.standardise(_modeled(spark, sf_dir), _SCALED).select("split", "row_id", *_SCALED))


def _fit_inputs(spark, sf_dir, branch: str = "shared"):
    df = _branches(spark, sf_dir)[branch]
    return df, features.feature_columns(df)


def _facts(model, df, name: str):
    """What any right fit of the loans must show: every loan scored once, measures within their bounds."""
    m = evaluation.classification_metrics(training.score(model, df, model_name=name))
    within = lambda c: F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False)).alias(f"{c}_in_range")
    tn, fp, fn, tp = (F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive"))
    return m.select(
        "model_name", "dataset_name", (tn + fp + fn + tp).alias("row_count"), (tp + fn).alias("positive_count"),
        within("roc_auc"), within("brier_score"),
        ((F.col("dataset_name") != "train") | (F.col("roc_auc") > 0.5)).alias("better_than_chance_on_train"),
    )


def _facts_sql(name: str, extra: str = "split IN ('train', 'test')") -> str:
    return check(
        f"""SELECT '{name}' AS model_name, split AS dataset_name, COUNT(*) AS row_count, CAST(SUM(target_default) AS BIGINT) AS positive_count,
            true AS roc_auc_in_range, true AS brier_score_in_range, true AS better_than_chance_on_train FROM m WHERE {extra} GROUP BY split"""
    )


_SHARED = [c for c in _BASE + _FLAGS if c not in ("row_id", "split", "target_default")]


@query(
    "m2_logistic_regression",
    check(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature_name, true AS gradient_vanishes, COUNT(*) AS train_rows, CAST(SUM(target_default) AS BIGINT) AS train_positives FROM m WHERE split = 'train'"
            for c in ["intercept", *_SHARED]
        )
    ),
)
def m2_logistic_regression(spark, sf_dir):
    """At the fitted coefficients the gradient of the penalised loss vanishes in every direction."""
    df, names = _fit_inputs(spark, sf_dir)
    train = training.standardise(df, names).filter("split = 'train'")
    model, info = training.logistic_regression(train, names)
    fitted = model.stages[-1]
    error = F.col("predicted_probability") - F.col("target_default")
    slopes = [F.avg(error).alias("g_intercept"), *[F.avg(error * F.col(c)).alias(f"g_{c}") for c in names]]
    sums = training.score(model, train).agg(*slopes, F.count(F.lit(1)).alias("rows"), F.sum("target_default").alias("positives"))
    penalty = {"intercept": 0.0, **{c: float(w) / info["rows"] for c, w in zip(names, fitted.coefficients, strict=True)}}
    small = lambda c: F.abs(F.col(f"g_{c}") + F.lit(penalty[c])) < TOLERANCE
    records = [record(feature_name=c, gradient_vanishes=small(c), train_rows=F.col("rows"), train_positives=F.col("positives")) for c in penalty]
    return rows_of(sums, [], records)


@query("m2_logistic_unscaled", _facts_sql("logistic_regression_unscaled"))
def m2_logistic_unscaled(spark, sf_dir):
    """The unscaled fit beside the scaled one, with both classes weighing the same."""
    df, names = _fit_inputs(spark, sf_dir)
    model, _ = training.logistic_regression(df.filter("split = 'train'"), names, class_weight="balanced")
    return _facts(model, df, "logistic_regression_unscaled")


@query("m3_random_forest", _facts_sql("random_forest"))
def m3_random_forest(spark, sf_dir):
    df, names = _fit_inputs(spark, sf_dir, "tree_no_log")
    model, _ = training.random_forest(df.filter("split = 'train'"), names, trees=TREES, max_depth=8)
    return _facts(model, df, "random_forest")


def weighted_branch(spark, sf_dir, branch: str = "shared"):
    """A branch with weights from the raw amounts: in the branch itself they are logged."""
    df, names = _fit_inputs(spark, sf_dir, branch)
    weights = features.with_weights(_modeled(spark, sf_dir), method="sqrt").select("split", "row_id", "sample_weight")
    return df.join(weights, ["split", "row_id"]), names


@query("m4_boosted_trees", _facts_sql("boosted_trees"))
def m4_boosted_trees(spark, sf_dir):
    weighted, names = weighted_branch(spark, sf_dir)
    model, _ = training.boosted_trees(
        weighted.filter("split = 'train'"), names, weight="sample_weight", iterations=ITERATIONS, depth=4
    )
    return _facts(model, weighted.drop("sample_weight"), "boosted_trees")


@query("m4_boosted_trees_native", _facts_sql("boosted_trees_native"))
def m4_boosted_trees_native(spark, sf_dir):
    base = _branches(spark, sf_dir)["native"]
    train = base.filter("split = 'train'")
    filled = features.impute(base, features.fit_medians(train, _IMPUTED))
    names = features.feature_columns(filled)
    model, _ = training.boosted_trees(
        filled.filter("split = 'train'"), names, categorical=RULES.categorical, iterations=ITERATIONS, depth=4
    )
    return _facts(model, filled, "boosted_trees_native")


@query("m4_histogram_boosting")
def m4_histogram_boosting(spark, sf_dir):
    """Symmetric histogram trees with leaf penalty and split noise on the weighted branch: a row per tree level,
    with the train and test AUC and Brier score of the fitted forest beside it."""
    weighted, names = weighted_branch(spark, sf_dir)
    forest = histogram_boosting.fit(
        weighted.filter("split = 'train'"), names, weight="sample_weight", iterations=500, learning_rate=0.05, depth=6,
        l2_leaf_reg=3.0, random_strength=1.0, border_count=128,
    )
    scored = histogram_boosting.predict(forest, weighted.filter("split IN ('train', 'test')"))
    scored = written_once(scored.select("split", "target_default", "predicted_probability"), "scored")
    measures = evaluation.auc(scored, ["split"], "target_default", "predicted_probability").join(
        scored.groupBy("split").agg(F.avg((F.col("predicted_probability") - F.col("target_default")) ** 2).alias("brier_score")), "split"
    )
    got = {r.split: r for r in measures.collect()}  # one row a split
    return histogram_boosting.splits_table(forest, spark).withColumns(
        {f"{s}_{m}": F.lit(float(got[s][c])) if s in got else F.lit(None).cast("double") for s in ("train", "test") for m, c in (("auc", "auc"), ("brier", "brier_score"))}
    )


def _ordered_sql(column: str) -> str:
    frame = f"OVER (PARTITION BY {column} ORDER BY o RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # Sums of 0/1 targets are whole numbers, so both engines divide the same two doubles: no rounding is needed.
    return f"(CAST(COALESCE(SUM(target_default) {frame}, 0) AS DOUBLE) + 0.5) / (CAST(COUNT(target_default) {frame} AS DOUBLE) + 1.0) AS {column}_ts"


@query(
    "m4_ordered_target_statistics",
    check(
        f"""SELECT row_id, purpose, home_ownership, {_ordered_sql('purpose')}, {_ordered_sql('home_ownership')}
            FROM (SELECT *, (row_id * 1000003 + 42) % 2147483647 AS o FROM m WHERE split = 'train')"""
    ),
)
def m4_ordered_target_statistics(spark, sf_dir):
    """Ordered target statistics of the categorical features of the train split: earlier rows in a seeded order only."""
    train = _modeled(spark, sf_dir).filter("split = 'train'")
    found = target_statistics.ordered_statistics(train, RULES.categorical, "target_default", target_statistics.seeded_order("row_id"))
    return found.select("row_id", "purpose", "home_ownership", "purpose_ts", "home_ownership_ts")


@query("m5_random_search_histogram")
def m5_random_search_histogram(spark, sf_dir):
    """The random search over all six settings with histogram trees, as published: every trial's setting and held-out AUC."""
    df, names = _fit_inputs(spark, sf_dir)
    _, results = training.random_search(df.filter("split = 'train'"), names, ["row_id"], booster="histogram")
    return results


@query(
    "m5_random_search",
    check(
        " UNION ALL ".join(
            f"SELECT CAST({t} AS BIGINT) AS trial_index, true AS settings_in_range, true AS auc_in_range, true AS ranked_by_auc, true AS best_is_first"
            for t in range(TRIALS)
        )
    ),
)
def m5_random_search(spark, sf_dir):
    df, names = _fit_inputs(spark, sf_dir)
    best, results = training.random_search(df.filter("split = 'train'"), names, ["row_id"], trials=TRIALS, ranges=RANGES)
    rows = [r.asDict() for r in results.collect()]  # one row a trial
    ranges = training.SEARCH_RANGES | RANGES
    areas = [r["roc_auc"] for r in rows]
    out = [
        {
            "trial_index": r["trial_index"],
            "settings_in_range": all(low <= r[n] <= high for n, (low, high) in ranges.items()),
            "auc_in_range": 0.0 <= r["roc_auc"] <= 1.0,
            "ranked_by_auc": areas == sorted(areas, reverse=True),
            "best_is_first": all(rows[0][n] == best[n] for n in ranges),
        }
        for r in rows
    ]
    return local_table(spark, out, "trial_index bigint, settings_in_range boolean, auc_in_range boolean, ranked_by_auc boolean, best_is_first boolean")


@query(
    "m6_stratified_holdout",
    check(
        """SELECT target_default, COUNT(*) AS row_count, CAST(ROUND(COUNT(*) * 0.2) AS BIGINT) AS holdout_count
           FROM m WHERE split = 'train' GROUP BY target_default"""
    ),
)
def m6_stratified_holdout(spark, sf_dir):
    train = train_of(_modeled(spark, sf_dir))
    parts = training.stratified_holdout(train, ["row_id"])
    return parts.groupBy("target_default").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if("is_holdout").alias("holdout_count")
    )


def _small_model(spark, sf_dir):
    df, names = _fit_inputs(spark, sf_dir)
    model, info = training.random_forest(df.filter("split = 'train'"), names, trees=5, max_depth=4)
    return df, names, model, info


@query("v2_validation_dataset", check("SELECT split, row_id, target_default, true AS probability_in_range FROM m"))
def v2_validation_dataset(spark, sf_dir):
    df, _, model, _ = _small_model(spark, sf_dir)
    clean_rows = validation.align_clean_rows(clean_loans(raw_loans(spark, sf_dir)), df)
    p = F.col("predicted_default_probability")
    return validation.validation_dataset(df, clean_rows, model).select(
        "split", "row_id", "target_default", F.coalesce(p.between(0.0, 1.0), F.lit(False)).alias("probability_in_range")
    )


@query(
    "e1_model_score",
    check("SELECT split, row_id, target_default, true AS probability_in_range, true AS label_follows_probability FROM m"),
)
def e1_model_score(spark, sf_dir):
    df, _, model, _ = _small_model(spark, sf_dir)
    p = F.col("predicted_probability")
    return training.score(model, df).select(
        "split", "row_id", "target_default", F.coalesce(p.between(0.0, 1.0), F.lit(False)).alias("probability_in_range"),
        (F.col("predicted_label") == (p >= 0.5).cast("bigint")).alias("label_follows_probability"),
    )


def _saved(spark, sf_dir):
    df, names, model, info = _small_model(spark, sf_dir)
    folder = shared_folder(spark, "model")
    metadata = {
        "selected_model": "random_forest",
        "model_family": "forest",
        "preprocessing_branch": "shared",
        "target_column": "target_default",
        "train_rows": info["rows"],
        "feature_count": len(names),
    }
    storage.save_model(spark, model, f"{folder}/forest", metadata)
    return df, model, f"{folder}/forest"


_GIVEN = ["selected_model", "model_family", "preprocessing_branch", "target_column", "train_rows", "feature_count", "row_identifier"]
_UNSAID = ",".join(sorted(k for k in storage.REQUIRED_METADATA if k not in _GIVEN))


@query(
    "a12_model_load",
    check(f"SELECT '{_UNSAID}' AS missing_keys, COUNT(*) AS scored_rows, CAST(0 AS DOUBLE) AS largest_difference FROM m"),
)
def a12_model_load(spark, sf_dir):
    """The loaded model scores every loan as the saved one did."""
    df, saved, path = _saved(spark, sf_dir)
    model, _, missing = storage.load_model(spark, path)
    ours = training.score(saved, df).select("split", "row_id", F.col("predicted_probability").alias("p"))
    both = training.score(model, df).join(ours, ["split", "row_id"])
    return both.agg(
        F.lit(",".join(missing)).alias("missing_keys"), F.count(F.lit(1)).alias("scored_rows"),
        F.max(F.abs(F.col("predicted_probability") - F.col("p"))).alias("largest_difference"),
    )


@query(
    "a14_model_save",
    check(
        f"""SELECT 'random_forest' AS selected_model, 'forest' AS model_family, 'shared' AS preprocessing_branch,
            'target_default' AS target_column, 'row_id' AS row_identifier, COUNT(*) AS train_rows,
            CAST({len(_SHARED)} AS BIGINT) AS feature_count, '{",".join(_SHARED)}' AS features FROM m WHERE split = 'train'"""
    ),
)
def a14_model_save(spark, sf_dir):
    """The saved record, with the features that the saved model itself takes."""
    _, _, path = _saved(spark, sf_dir)
    model, metadata, _ = storage.load_model(spark, path)
    taken = ",".join(model.stages[0].getInputCols())
    return metadata.select(*[F.col(c) for c in _GIVEN], F.lit(taken).alias("features"))
