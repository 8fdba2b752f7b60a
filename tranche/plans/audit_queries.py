"""Catalogue: profiles, structure and drift (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tranche.operators import drift, profile
from tranche.operators.cohort import SPLITS
from tranche.plans.audit_frames import (
    FRAMES_SQL,
    NULLS_SQL,
    TEST_TYPES,
    TRAIN_TYPES,
    audit_test,
    audit_train,
    with_nulls,
)
from tranche.plans.loans import clean_loans, modeled_loans, raw_loans, test_of, train_of
from tranche.plans.registry import check, n, query, r, rounded

_PERCENT = "ROUND(AVG(CAST(value IS NULL AS DOUBLE)) * 100, 2)"


def _names(types: dict[str, str], *wanted: str) -> str:
    return ", ".join(f"'{c}'" for c, t in types.items() if t in wanted)


def _inspect_sql(side: str) -> str:
    return f"""{side}_inspect AS (
      SELECT column_name, dtype, {n('COUNT(DISTINCT value) + MAX(CAST(value IS NULL AS INT))')} AS n_unique,
        COUNT(*) - COUNT(value) AS null_count, {_PERCENT} AS null_percent,
        dtype <> 'string' AS is_numeric, dtype = 'string' AS is_object,
        dtype = 'string' AND COUNT(CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END) > 0
          AND COUNT(TRY_CAST(value AS DOUBLE)) > 0 AS is_mixed_type,
        dtype = 'string' AND COUNT(value) > 0
          AND COUNT(CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN value END) = 0 AS is_numeric_object,
        {_PERCENT} = 100 AS is_fully_null,
        COUNT(DISTINCT value) + MAX(CAST(value IS NULL AS INT)) <= 1 AND {_PERCENT} <> 100 AS is_constant
      FROM {side}_long JOIN {side}_types USING (column_name) GROUP BY column_name, dtype)"""


def _string_audit_sql(side: str, types: dict[str, str]) -> str:
    return f"""{side}_strings AS (
      SELECT column_name, 'string' AS dtype,
        {n('COUNT(DISTINCT value) + MAX(CAST(value IS NULL AS INT))')} AS unique_count_including_null,
        COUNT(DISTINCT value) AS unique_count_non_null, {_PERCENT} AS null_percent,
        COALESCE(array_to_string(list_sort(list(DISTINCT TRIM(value)) FILTER (WHERE value IS NOT NULL))[1:5], '|'), '') AS sample_values
      FROM {side}_long WHERE column_name IN ({_names(types, 'string')}) GROUP BY column_name)"""


def _numeric_audit_sql(side: str, types: dict[str, str]) -> str:
    return f"""{side}_numbers AS (
      SELECT column_name, dtype, unique_count_including_null, unique_count_non_null, null_percent,
             mean, median, std, min, max FROM (
      SELECT column_name,
        {n('COUNT(DISTINCT value) + MAX(CAST(value IS NULL AS INT))')} AS unique_count_including_null,
        COUNT(DISTINCT value) AS unique_count_non_null, {_PERCENT} AS null_percent,
        AVG(CAST(value AS DOUBLE)) AS mean, MEDIAN(CAST(value AS DOUBLE)) AS median,
        STDDEV_SAMP(CAST(value AS DOUBLE)) AS std, MIN(CAST(value AS DOUBLE)) AS min, MAX(CAST(value AS DOUBLE)) AS max
      FROM {side}_long WHERE column_name IN ({_names(types, 'bigint', 'double')}) GROUP BY column_name)
      JOIN {side}_types USING (column_name))"""


_INSPECTS = (*NULLS_SQL, _inspect_sql("train"), _inspect_sql("test"))
_STRINGS = (*FRAMES_SQL, _string_audit_sql("train", TRAIN_TYPES), _string_audit_sql("test", TEST_TYPES))
_NUMBERS = (*FRAMES_SQL, _numeric_audit_sql("train", TRAIN_TYPES), _numeric_audit_sql("test", TEST_TYPES))

_UNIVERSE_SQL = (
    *_INSPECTS,
    """universe AS (SELECT column_name, s.train_dtype, s.test_dtype, s.present_in_train, s.present_in_test, s.dtype_mismatch,
        a.n_unique AS train_n_unique, b.n_unique AS test_n_unique, a.null_percent AS train_null_percent, b.null_percent AS test_null_percent,
        a.is_fully_null AS train_is_fully_null, b.is_fully_null AS test_is_fully_null,
        a.is_constant AS train_is_constant, b.is_constant AS test_is_constant,
        GREATEST(a.null_percent, b.null_percent) AS max_null_percent, b.null_percent - a.null_percent AS null_gap_test_minus_train
        FROM schema_nulls s LEFT JOIN train_inspect a USING (column_name) LEFT JOIN test_inspect b USING (column_name))""",
)
_ISSUES_SQL = (
    *_UNIVERSE_SQL,
    """issues AS (
        SELECT column_name, 'Present in train only' AS issue, 'train' AS applies_to FROM universe WHERE present_in_train AND NOT present_in_test
        UNION ALL SELECT column_name, 'Present in test only', 'test' FROM universe WHERE present_in_test AND NOT present_in_train
        UNION ALL SELECT column_name, 'Dtype mismatch', 'both' FROM universe WHERE dtype_mismatch
        UNION ALL SELECT column_name, CASE WHEN train_is_fully_null THEN '100% Null' ELSE 'High Missing (>50%)' END, 'train' FROM universe WHERE present_in_train AND train_null_percent >= 50
        UNION ALL SELECT column_name, CASE WHEN test_is_fully_null THEN '100% Null' ELSE 'High Missing (>50%)' END, 'test' FROM universe WHERE present_in_test AND test_null_percent >= 50
        UNION ALL SELECT column_name, 'Constant', 'train' FROM universe WHERE train_is_constant
        UNION ALL SELECT column_name, 'Constant', 'test' FROM universe WHERE test_is_constant)""",
)


def _both(spark, sf_dir):
    return audit_train(spark, sf_dir), audit_test(spark, sf_dir)


def _each(table: str, columns: str = "*") -> str:
    return f"SELECT {columns}, 'train' AS split FROM train_{table} UNION ALL SELECT {columns}, 'test' AS split FROM test_{table}"


def _of_both(spark, sf_dir, audit):
    train, test = (audit(df).withColumn("split", F.lit(s)) for df, s in zip(_both(spark, sf_dir), SPLITS, strict=True))
    return train.unionByName(test)


@query("b1_inspect", check(_each("inspect"), *_INSPECTS))
def b1_inspect(spark, sf_dir):
    return _of_both(spark, sf_dir, profile.inspect)


@query("b2_audit_strings", check(_each("strings"), *_STRINGS))
def b2_audit_strings(spark, sf_dir):
    audit = _of_both(spark, sf_dir, profile.audit_strings)
    return audit.withColumn("sample_values", F.array_join("sample_values", "|"))


def _numbers_sql(side: str, extra: str = "") -> str:
    stats = ", ".join(f"{r(c)} AS {c}" for c in ("mean", "median", "std", "min", "max"))
    return f"""SELECT column_name, dtype, unique_count_including_null, unique_count_non_null, null_percent, {stats} {extra}
        FROM {side}_numbers"""


@query("b3_audit_numbers", check(_numbers_sql("train", ", 'train' AS split") + " UNION ALL " + _numbers_sql("test", ", 'test' AS split"), *_NUMBERS))
def b3_audit_numbers(spark, sf_dir):
    return rounded(_of_both(spark, sf_dir, profile.audit_numbers))


@query(
    "b4_residual_text",
    check(
        " UNION ALL ".join(rf"""SELECT '{side}' AS dataset_split, column_name, 'string' AS dtype, missing_count, missing_rate_percent,
            unique_count_including_missing, COALESCE(array_to_string(samples, ' | '), 'no non-missing values') AS sample_values,
            COALESCE(len(list_filter(samples, lambda x: regexp_matches(x, '[%$,]')
              OR regexp_matches(REPLACE(regexp_replace(regexp_replace(x, '\.', ''), '-', ''), '%', ''), '^[0-9]+$'))) > 0, false)
              AS suspicious_numeric_like_text
            FROM (SELECT column_name, COUNT(*) - COUNT(value) AS missing_count, {_PERCENT} AS missing_rate_percent,
                {n('COUNT(DISTINCT value) + MAX(CAST(value IS NULL AS INT))')} AS unique_count_including_missing,
                list_sort(list(DISTINCT value) FILTER (WHERE value IS NOT NULL))[1:5] AS samples
                FROM {side}_long WHERE column_name IN ({_names(types, 'string')}) GROUP BY column_name)"""
            for side, types in (("train", TRAIN_TYPES), ("test", TEST_TYPES))),
        *FRAMES_SQL,
    ),
)
def b4_residual_text(spark, sf_dir):
    train, test = _both(spark, sf_dir)
    return profile.residual_text(train, "train").unionByName(profile.residual_text(test, "test"))


@query("b5_schema_compare", check("SELECT * FROM schema_nulls", *NULLS_SQL))
def b5_schema_compare(spark, sf_dir):
    train, test = _both(spark, sf_dir)
    return with_nulls(drift.schema_compare(train, test), train, test)


@query(
    "b6_schema_summary",
    check(
        f"""SELECT (SELECT COUNT(*) FROM atrain) AS train_rows, (SELECT COUNT(*) FROM atest) AS test_rows,
            {n(len(TRAIN_TYPES))} AS train_cols, {n(len(TEST_TYPES))} AS test_cols,
            COUNT(*) FILTER (WHERE present_in_train AND NOT present_in_test) AS train_only_count,
            COUNT(*) FILTER (WHERE present_in_test AND NOT present_in_train) AS test_only_count,
            COUNT(*) FILTER (WHERE dtype_mismatch) AS dtype_mismatch_count FROM schema_nulls""",
        *NULLS_SQL,
    ),
)
def b6_schema_summary(spark, sf_dir):
    return drift.schema_summary(*_both(spark, sf_dir))


@query(
    "b6_schema_deltas",
    check("SELECT * FROM schema_nulls WHERE dtype_mismatch OR present_in_train <> present_in_test", *NULLS_SQL),
)
def b6_schema_deltas(spark, sf_dir):
    train, test = _both(spark, sf_dir)
    return with_nulls(drift.schema_deltas(drift.schema_compare(train, test)), train, test)


_UNIVERSE_COLUMNS = [
    "column_name", "train_dtype", "test_dtype", "present_in_train", "present_in_test", "dtype_mismatch",
    "train_n_unique", "test_n_unique", "train_null_percent", "test_null_percent", "train_is_fully_null",
    "test_is_fully_null", "train_is_constant", "test_is_constant", "max_null_percent", "null_gap_test_minus_train",
]
_UNIVERSE_SELECT = ", ".join(r(c) + f" AS {c}" if c == "null_gap_test_minus_train" else c for c in _UNIVERSE_COLUMNS)


@query("b7_feature_universe", check(f"SELECT {_UNIVERSE_SELECT} FROM universe", *_UNIVERSE_SQL))
def b7_feature_universe(spark, sf_dir):
    return rounded(drift.feature_universe(*_both(spark, sf_dir)).select(*_UNIVERSE_COLUMNS))


_ACTION_SELECT = ", ".join(
    r(c) + f" AS {c}" if c == "null_gap_test_minus_train" else c for c in _UNIVERSE_COLUMNS if not c.endswith("n_unique")
)


@query(
    "b8_action_list",
    check(
        f"""SELECT {_ACTION_SELECT} FROM universe WHERE dtype_mismatch OR present_in_train <> present_in_test
            OR max_null_percent >= 50 OR COALESCE(train_is_constant, false) OR COALESCE(test_is_constant, false)""",
        *_UNIVERSE_SQL,
    ),
)
def b8_action_list(spark, sf_dir):
    return rounded(drift.action_list(drift.feature_universe(*_both(spark, sf_dir))))


def _issues(spark, sf_dir):
    return drift.structural_issues(drift.feature_universe(*_both(spark, sf_dir)))


@query("b9_structural_issues", check("SELECT * FROM issues", *_ISSUES_SQL))
def b9_structural_issues(spark, sf_dir):
    return _issues(spark, sf_dir)


@query("b10_issue_counts", check("SELECT issue, COUNT(*) AS count FROM issues GROUP BY issue", *_ISSUES_SQL))
def b10_issue_counts(spark, sf_dir):
    return drift.issue_counts(_issues(spark, sf_dir))


@query(
    "b11_issue_examples",
    check(
        """SELECT column_name, issue, applies_to FROM issues
           QUALIFY ROW_NUMBER() OVER (PARTITION BY issue ORDER BY column_name, applies_to) <= 5""",
        *_ISSUES_SQL,
    ),
)
def b11_issue_examples(spark, sf_dir):
    return drift.issue_examples(_issues(spark, sf_dir))


_ACTION_CASE = "CASE issue " + " ".join(f"WHEN '{i}' THEN '{a}'" for i, a in drift.ACTIONS.items()) + " END"


@query(
    "b12_decision_queue",
    check(f"SELECT column_name, issue, applies_to, {_ACTION_CASE} AS recommended_action FROM issues", *_ISSUES_SQL),
)
def b12_decision_queue(spark, sf_dir):
    return drift.decision_queue(_issues(spark, sf_dir))


@query(
    "b13_compare_values",
    check(
        """SELECT TRIM(home_ownership) AS value, BOOL_OR(split = 'train') AS present_in_training,
           BOOL_OR(split = 'test') AS present_in_test FROM loans GROUP BY 1"""
    ),
)
def b13_compare_values(spark, sf_dir):
    return drift.compare_values(*_both(spark, sf_dir), "home_ownership")


@query(
    "b14_string_audits",
    check(
        "SELECT *, 'train' AS split FROM train_strings UNION ALL SELECT *, 'test' AS split FROM test_strings", *_STRINGS
    ),
)
def b14_string_audits(spark, sf_dir):
    audits = drift.string_audits(*_both(spark, sf_dir))
    return audits.withColumn("sample_values", F.array_join("sample_values", "|"))


@query(
    "b15_numeric_audits",
    check(_numbers_sql("train", ", 'train' AS split") + " UNION ALL " + _numbers_sql("test", ", 'test' AS split"), *_NUMBERS),
)
def b15_numeric_audits(spark, sf_dir):
    return rounded(drift.numeric_audits(*_both(spark, sf_dir)))


def _aligned_sql(name: str, audits: str, stats: tuple[str, ...], changed: str) -> str:
    measures = {"dtype": "dtype", "unique_count_including_null": "unique_including_null",
                "unique_count_non_null": "unique_non_null", "null_percent": "null_percent"}
    measures.update({s: s for s in stats})
    sides = ", ".join(f"a.{m} AS {o}_train, b.{m} AS {o}_test" for m, o in measures.items())
    gaps = "".join(f", b.{s} - a.{s} AS {s}_gap_test_minus_train" for s in stats if s != "sample_values")
    return f"""{name} AS (SELECT column_name, {sides},
        a.dtype IS NOT NULL AS present_in_train, b.dtype IS NOT NULL AS present_in_test,
        COALESCE(a.dtype <> b.dtype, false) AS dtype_mismatch,
        COALESCE(b.unique_count_non_null, 0) - COALESCE(a.unique_count_non_null, 0) AS unique_non_null_gap_test_minus_train,
        b.null_percent - a.null_percent AS null_gap_test_minus_train,
        GREATEST(a.null_percent, b.null_percent) AS max_null_percent {gaps},
        (a.dtype IS NULL) <> (b.dtype IS NULL) OR COALESCE(a.dtype <> b.dtype, false)
          OR a.null_percent IS DISTINCT FROM b.null_percent OR {changed} AS has_difference
        FROM train_{audits} a FULL JOIN test_{audits} b USING (column_name))"""


_STATS = ("mean", "median", "std", "min", "max")
ALIGNED_STRINGS = (
    *_STRINGS,
    _aligned_sql("aligned", "strings", ("sample_values",), "a.unique_count_non_null IS DISTINCT FROM b.unique_count_non_null"),
)
ALIGNED_NUMBERS = (
    *_NUMBERS,
    _aligned_sql(
        "aligned", "numbers", _STATS,
        " OR ".join(f"ROUND(a.{s}, 6) IS DISTINCT FROM ROUND(b.{s}, 6)" for s in ("mean", "median", "std")),
    ),
)
_NUMBER_COLUMNS = [f"{s}_{side}" for s in _STATS for side in ("train", "test", "gap_test_minus_train")]


def _string_select(table: str = "aligned", extra: str = "") -> str:
    return f"""SELECT * REPLACE ({r('null_gap_test_minus_train')} AS null_gap_test_minus_train) {extra} FROM {table}"""


def number_select(extra: str = "") -> str:
    shown = ", ".join(f"{r(c)} AS {c}" for c in ["null_gap_test_minus_train", *_NUMBER_COLUMNS])
    return f"SELECT * REPLACE ({shown}) {extra} FROM aligned"


def _flat_samples(df):
    return df.withColumns({c: F.array_join(c, "|") for c in ("sample_values_train", "sample_values_test")})


@query("b16_align_strings", check(_string_select(), *ALIGNED_STRINGS))
def b16_align_strings(spark, sf_dir):
    return rounded(_flat_samples(drift.align_strings(drift.string_audits(*_both(spark, sf_dir)))))


@query("b17_align_numbers", check(number_select(), *ALIGNED_NUMBERS))
def b17_align_numbers(spark, sf_dir):
    return rounded(drift.align_numbers(drift.numeric_audits(*_both(spark, sf_dir))))


_XOR = "CASE WHEN present_in_train <> present_in_test THEN 100 ELSE 0 END + CASE WHEN dtype_mismatch THEN 60 ELSE 0 END + CASE WHEN ABS(null_gap_test_minus_train) >= 5 THEN 20 ELSE 0 END"
_STRING_SCORE = f"{_XOR} + CASE WHEN ABS(unique_non_null_gap_test_minus_train) >= 10 THEN 10 ELSE 0 END"
_NUMBER_SCORE = f"{_XOR} + " + " + ".join(
    f"CASE WHEN ABS({s}_gap_test_minus_train) > 0 THEN 10 ELSE 0 END" for s in ("mean", "median", "std")
)
TOP_NUMBERS = f""" WHERE has_difference ORDER BY {_NUMBER_SCORE} DESC,
    ABS(aligned.null_gap_test_minus_train) DESC NULLS LAST, ABS(aligned.mean_gap_test_minus_train) DESC NULLS LAST,
    ABS(aligned.median_gap_test_minus_train) DESC NULLS LAST, ABS(aligned.std_gap_test_minus_train) DESC NULLS LAST, column_name"""
_TOP_STRINGS = f"""top AS (SELECT *, {_STRING_SCORE} AS severity_score FROM aligned WHERE has_difference
    ORDER BY severity_score DESC, ABS(null_gap_test_minus_train) DESC NULLS LAST, ABS(unique_non_null_gap_test_minus_train) DESC NULLS LAST, column_name
    LIMIT 6)"""


@query(
    "b18_top_string_deltas",
    check(_string_select("top"), *ALIGNED_STRINGS, _TOP_STRINGS),
)
def b18_top_string_deltas(spark, sf_dir):
    deltas = drift.align_strings(drift.string_audits(*_both(spark, sf_dir))).filter("has_difference")
    return rounded(_flat_samples(drift.top_string_deltas(deltas, 6)))


@query(
    "b19_top_numeric_deltas",
    check(
        number_select(f", {_NUMBER_SCORE} AS severity_score")
        + TOP_NUMBERS
        + " LIMIT 5",
        *ALIGNED_NUMBERS,
    ),
)
def b19_top_numeric_deltas(spark, sf_dir):
    deltas = drift.align_numbers(drift.numeric_audits(*_both(spark, sf_dir))).filter("has_difference")
    return rounded(drift.top_numeric_deltas(deltas, 5))


_VALUES_SQL = """SELECT column_name, value, present_in FROM (
      SELECT column_name, TRIM(value) AS value, MIN(side) || '_only' AS present_in
      FROM (SELECT column_name, value, 'train' AS side FROM train_long UNION ALL SELECT column_name, value, 'test' FROM test_long)
      WHERE value IS NOT NULL AND column_name IN (SELECT column_name FROM top LIMIT 5)
      GROUP BY column_name, TRIM(value) HAVING MIN(side) = MAX(side))
    QUALIFY ROW_NUMBER() OVER (PARTITION BY column_name, present_in ORDER BY value) <= 10"""


@query("b20_value_differences", check(_VALUES_SQL, *ALIGNED_STRINGS, _TOP_STRINGS))
def b20_value_differences(spark, sf_dir):
    train, test = _both(spark, sf_dir)
    deltas = drift.align_strings(drift.string_audits(train, test)).filter("has_difference")
    return drift.value_differences(train, test, drift.top_string_deltas(deltas, 6), columns=5, per_side=10)


def _report_sql(prefix: str) -> str:
    return f"""SELECT COUNT(*) FILTER (WHERE present_in_train) AS {prefix}_train, COUNT(*) FILTER (WHERE present_in_test) AS {prefix}_test,
        COUNT(*) AS {prefix}_union, COUNT(*) FILTER (WHERE has_difference) AS {prefix}_with_differences,
        LEAST(COUNT(*) FILTER (WHERE has_difference), CAST(10 AS BIGINT)) AS top_k_returned FROM aligned"""


@query("b21_string_drift_report", check(_report_sql("string_like_cols"), *ALIGNED_STRINGS))
def b21_string_drift_report(spark, sf_dir):
    return drift.string_drift_report(*_both(spark, sf_dir))["summary"]


@query("b22_numeric_drift_report", check(_report_sql("numeric_cols"), *ALIGNED_NUMBERS))
def b22_numeric_drift_report(spark, sf_dir):
    return drift.numeric_drift_report(*_both(spark, sf_dir))["summary"]


@query(
    "b23_dataset_overview",
    check(
        f"""SELECT 'train' AS dataset_split, COUNT(*) AS rows, {n(len(TRAIN_TYPES))} AS columns FROM atrain
            UNION ALL SELECT 'test', COUNT(*), {n(len(TEST_TYPES))} FROM atest""",
        *FRAMES_SQL,
    ),
)
def b23_dataset_overview(spark, sf_dir):
    return profile.dataset_overview(*_both(spark, sf_dir))


_MEANS = ["loan_amnt", "annual_inc", "dti"]
_MEANS_SQL = ", ".join(f"ROUND(AVG({c}), 2) AS {c}" for c in _MEANS)


@query(
    "b24_split_table",
    check(f"SELECT split AS dataset_split, home_ownership, {_MEANS_SQL} FROM clean GROUP BY split, home_ownership"),
)
def b24_split_table(spark, sf_dir):
    clean = clean_loans(raw_loans(spark, sf_dir))
    means = [profile.group_means(part(clean), "home_ownership", _MEANS) for part in (train_of, test_of)]
    return profile.split_table(*means, key="home_ownership")


_GROUPS = {
    "borrower": ["annual_inc", "emp_length_years", "home_ownership", "dti", "zip_code"],
    "loan": ["loan_amnt", "term_months", "purpose", "dti"],
    "history": ["open_acc", "revol_bal", "mths_since_last_delinq", "tot_coll_amt"],
}


@query(
    "b25_group_coverage",
    check(
        f"""SELECT 'borrower' AS feature_group, {n(5)} AS grouped_feature_count, {n(4)} AS present_feature_count, {n(1)} AS missing_feature_count,
            COUNT(annual_inc) + COUNT(emp_length_years) + COUNT(home_ownership) + COUNT(dti) AS non_null_values FROM clean
            UNION ALL SELECT 'loan', 4, 4, 0, COUNT(loan_amnt) + COUNT(term_months) + COUNT(purpose) + COUNT(dti) FROM clean
            UNION ALL SELECT 'history', 4, 3, 1, COUNT(open_acc) + COUNT(revol_bal) + COUNT(mths_since_last_delinq) FROM clean"""
    ),
)
def b25_group_coverage(spark, sf_dir):
    return drift.group_coverage(clean_loans(raw_loans(spark, sf_dir)), _GROUPS)["coverage_summary"]


@query(
    "b26_numeric_summary",
    check(
        """SELECT 'dti' AS feature_name, split AS dataset_split, COUNT(dti) AS count,
            ROUND(AVG(CAST(dti IS NULL AS DOUBLE)) * 100, 2) AS missing_percent, ROUND(AVG(dti), 2) AS mean,
            ROUND(quantile_cont(dti, 0.5), 2) AS median, ROUND(quantile_cont(dti, 0.05), 2) AS p05,
            ROUND(quantile_cont(dti, 0.95), 2) AS p95 FROM clean GROUP BY split"""
    ),
)
def b26_numeric_summary(spark, sf_dir):
    return profile.numeric_summary(clean_loans(raw_loans(spark, sf_dir)), "dti")


@query("b27_group_means", check(f"SELECT purpose, {_MEANS_SQL} FROM clean GROUP BY purpose"))
def b27_group_means(spark, sf_dir):
    return profile.group_means(clean_loans(raw_loans(spark, sf_dir)), "purpose", _MEANS)


_AUDITED = {
    "loan_amnt": "double", "purpose": "string", "home_ownership": "string", "pymnt_plan": "int",
    "has_mths_since_last_delinq": "tinyint", "term_months": "smallint", "dti": "double",
}


@query(
    "b28_model_feature_audit",
    check(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature_name, '{t}' AS train_dtype, '{t}' AS test_dtype,
            '{'categorical' if t == 'string' else 'numeric'}' AS feature_group,
            {'false' if t == 'string' else f'COUNT(DISTINCT {c}) <= 2'} AS is_binary,
            COUNT(DISTINCT {c}) FILTER (WHERE split = 'train') AS train_non_null_unique_values,
            COUNT(DISTINCT {c}) FILTER (WHERE split = 'test') AS test_non_null_unique_values,
            false AS requires_manual_review FROM m"""
            for c, t in _AUDITED.items()
        )
    ),
)
def b28_model_feature_audit(spark, sf_dir):
    modeled = modeled_loans(raw_loans(spark, sf_dir)).select("split", "target_default", *_AUDITED)
    return drift.model_feature_audit(train_of(modeled), test_of(modeled), "target_default")


_SKEWED = ["loan_amnt", "annual_inc", "dti", "revol_bal", "open_acc"]


@query(
    "b29_skewness",
    check(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS feature_name, COUNT({c}) AS non_null_count, {r(f'SKEWNESS({c})')} AS skewness, {r(f'MIN({c})')} AS min_value,
            {r(f'MEDIAN({c})')} AS median_value, {r(f'AVG({c})')} AS mean_value, {r(f'MAX({c})')} AS max_value FROM m WHERE split = 'train'"""
            for c in _SKEWED
        )
    ),
)
def b29_skewness(spark, sf_dir):
    return rounded(profile.skewness_summary(train_of(modeled_loans(raw_loans(spark, sf_dir))), _SKEWED))


@query(
    "b30_year_range",
    check(
        """SELECT split AS dataset_split, MIN(issue_year) AS min_issue_year, MAX(issue_year) AS max_issue_year,
           COUNT(DISTINCT issue_year) AS distinct_issue_years FROM clean GROUP BY split"""
    ),
)
def b30_year_range(spark, sf_dir):
    return profile.year_range(clean_loans(raw_loans(spark, sf_dir)))


@query(
    "b31_status_by_split",
    check(
        """SELECT loan_status, COUNT(*) FILTER (WHERE split = 'train') AS train_count,
           COUNT(*) FILTER (WHERE split = 'test') AS test_count FROM clean GROUP BY loan_status"""
    ),
)
def b31_status_by_split(spark, sf_dir):
    return profile.status_by_split(clean_loans(raw_loans(spark, sf_dir)))


@query(
    "b32_status_shares",
    check(
        """SELECT split, loan_status, COUNT(*) AS count, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY split) * 100, 2) AS percentage
           FROM clean GROUP BY split, loan_status"""
    ),
)
def b32_status_shares(spark, sf_dir):
    return profile.status_shares(clean_loans(raw_loans(spark, sf_dir)), by=["split"])
