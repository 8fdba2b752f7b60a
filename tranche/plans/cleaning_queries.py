"""Catalogue: cleaning and typing (C), cohort and exploratory tables (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tranche import contracts
from tranche.operators import cleaning, cohort, drift
from tranche.plans.audit_frames import NULLS_SQL, audit_test, audit_train, with_nulls
from tranche.plans.loans import clean_loans, modeled_loans, raw_loans, stored_loans, table
from tranche.functions.shape import local_table
from tranche.plans.registry import check, n, query, r, rounded
from tranche.plans.session import shared_folder

# Columns that leave the clean layer before modeling.
EXCLUDED = ["issue_d", "pymnt_plan"]
BENCHMARK = ["grade", "sub_grade", "int_rate"]


@query(
    "c1_row_id",
    """SELECT split, o_orderkey, ROW_NUMBER() OVER (PARTITION BY split ORDER BY o_orderkey) AS row_id
       FROM (SELECT CASE WHEN YEAR(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS split, o_orderkey FROM orders)""",
)
def c1_row_id(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.when(F.year("o_orderdate") < 2000, "train").otherwise("test").alias("split"), "o_orderkey"
    )
    return cleaning.with_row_ids(orders, "o_orderkey")


@query("c2_sentinel", check("SELECT split, row_id, has_mths_since_last_delinq, mths_since_last_delinq FROM clean"))
def c2_sentinel(spark, sf_dir):
    df = cleaning.sentinel(raw_loans(spark, sf_dir), ["mths_since_last_delinq"])
    return df.select("split", "row_id", "has_mths_since_last_delinq", "mths_since_last_delinq")


@query("c3_parse_month", check("SELECT split, row_id, strftime(issue_d, '%Y-%m-%d') AS issue_month FROM clean"))
def c3_parse_month(spark, sf_dir):
    df = cleaning.parse_months(raw_loans(spark, sf_dir), ["issue_d", "last_pymnt_d"])
    return df.select("split", "row_id", F.date_format("issue_d", "yyyy-MM-dd").alias("issue_month"))


@query("c4_percent_to_double", check("SELECT split, row_id, int_rate FROM clean"))
def c4_percent_to_double(spark, sf_dir):
    return cleaning.percent_to_double(raw_loans(spark, sf_dir), ["int_rate", "revol_util"]).select(
        "split", "row_id", "int_rate"
    )


@query("c5_employment_years", check("SELECT split, row_id, CAST(emp_length_years AS DOUBLE) AS emp_length_years FROM clean"))
def c5_employment_years(spark, sf_dir):
    df = cleaning.employment_years(raw_loans(spark, sf_dir))
    return df.select("split", "row_id", F.col("emp_length_years").cast("double").alias("emp_length_years"))


@query("c6_home_ownership", check("SELECT split, row_id, home_ownership FROM clean"))
def c6_home_ownership(spark, sf_dir):
    return cleaning.collapse_home_ownership(raw_loans(spark, sf_dir)).select("split", "row_id", "home_ownership")


@query("c7_normalise_text", check("SELECT split, row_id, loan_status, purpose FROM clean"))
def c7_normalise_text(spark, sf_dir):
    df = cleaning.normalise_text(raw_loans(spark, sf_dir), ["loan_status", "purpose"])
    return df.select("split", "row_id", "loan_status", "purpose")


@query(
    "c8_map_values",
    check(
        """SELECT split, row_id, CAST(pymnt_plan = 'y' AS INT) AS pymnt_plan,
           CASE LOWER(TRIM(home_ownership)) WHEN 'rent' THEN 'tenant' WHEN 'own' THEN 'owner' ELSE LOWER(TRIM(home_ownership)) END AS housing
           FROM loans"""
    ),
)
def c8_map_values(spark, sf_dir):
    df = cleaning.map_values(raw_loans(spark, sf_dir), "pymnt_plan", cleaning.PAYMENT_PLAN_CODES)
    df = cleaning.map_values(df, "home_ownership", {"rent": "tenant", "own": "owner"}, output="housing", allow_unmapped=True)
    return df.select("split", "row_id", "pymnt_plan", "housing")


@query("c9_term_months", check("SELECT split, row_id, CAST(term_months AS BIGINT) AS term_months FROM clean"))
def c9_term_months(spark, sf_dir):
    df = cleaning.term_months(raw_loans(spark, sf_dir))
    return df.select("split", "row_id", F.col("term_months").cast("bigint").alias("term_months"))


_SPACE_SQL = """space AS (
  SELECT column_name, category, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY category) AS code,
         MAX(CAST(split = 'train' AS BIGINT)) AS in_train, MAX(CAST(split = 'test' AS BIGINT)) AS in_test
  FROM (SELECT split, 'home_ownership' AS column_name, home_ownership AS category FROM loans
        UNION ALL SELECT split, 'emp_length', emp_length FROM loans
        UNION ALL SELECT split, 'sub_grade', sub_grade FROM loans)
  WHERE category IS NOT NULL GROUP BY column_name, category)"""


@query("c10_category_space", check("SELECT column_name, category, code, in_train, in_test FROM space", _SPACE_SQL))
def c10_category_space(spark, sf_dir):
    return cleaning.category_space(raw_loans(spark, sf_dir), ["home_ownership", "emp_length", "sub_grade"])


@query(
    "c10_category_codes",
    check(
        """SELECT l.split, l.row_id, l.emp_length, s.code AS emp_length_code
           FROM loans l LEFT JOIN space s ON s.column_name = 'emp_length' AND s.category = l.emp_length""",
        _SPACE_SQL,
    ),
)
def c10_category_codes(spark, sf_dir):
    loans = raw_loans(spark, sf_dir)
    space = cleaning.category_space(loans, ["emp_length"])
    coded = cleaning.with_category_codes(loans, space, "emp_length", "emp_length_code")
    return coded.select("split", "row_id", "emp_length", "emp_length_code")


@query("c11_align_numeric_types", check("SELECT split, row_id, CAST(open_acc AS DOUBLE) AS open_acc, dti FROM loans"))
def c11_align_numeric_types(spark, sf_dir):
    train, test = cleaning.align_numeric_types(audit_train(spark, sf_dir), audit_test(spark, sf_dir))
    columns = ["split", "row_id", "open_acc", "dti"]
    return train.withColumn("split", F.lit("train")).select(columns).unionByName(
        test.withColumn("split", F.lit("test")).select(columns)
    )


@query(
    "c12_drop_report",
    check(
        """SELECT 'loans' AS dataset_name, 'emp_length' AS column_name, 'dropped' AS action, COUNT(emp_length) AS non_null FROM loans
           UNION ALL SELECT 'loans', 'dti', 'dropped', COUNT(dti) FROM loans
           UNION ALL SELECT 'loans', 'desc', 'missing', 0"""
    ),
)
def c12_drop_report(spark, sf_dir):
    _, report = cleaning.drop_with_report(raw_loans(spark, sf_dir), ["emp_length", "dti", "desc", "dti"], "loans")
    return report


@query(
    "c13_feature_base",
    check(f"SELECT * EXCLUDE ({', '.join(EXCLUDED + BENCHMARK)}) FROM clean"),
)
def c13_feature_base(spark, sf_dir):
    return cleaning.project_layer(clean_loans(raw_loans(spark, sf_dir)), EXCLUDED, BENCHMARK)


@query(
    "c14_row_count_kept",
    check(
        """SELECT split, COUNT(*) AS rows_before, COUNT(*) AS rows_after, CAST(0 AS BIGINT) AS violations
           FROM loans GROUP BY split"""
    ),
)
def c14_row_count_kept(spark, sf_dir):
    loans = raw_loans(spark, sf_dir)
    return contracts.row_count_kept(loans, clean_loans(loans), "split")


@query(
    "c15_schema_match",
    check("SELECT * FROM schema_nulls WHERE NOT (present_in_train AND present_in_test)", *NULLS_SQL),
)
def c15_schema_match(spark, sf_dir):
    train, test = audit_train(spark, sf_dir), audit_test(spark, sf_dir)
    compared = drift.schema_compare(train, test).filter(~(F.col("present_in_train") & F.col("present_in_test")))
    return with_nulls(compared, train, test)


@query("c16_type_match", check("SELECT * FROM schema_nulls WHERE dtype_mismatch", *NULLS_SQL))
def c16_type_match(spark, sf_dir):
    train, test = audit_train(spark, sf_dir), audit_test(spark, sf_dir)
    return with_nulls(drift.schema_compare(train, test).filter("dtype_mismatch"), train, test)


@query(
    "c17_unique_key",
    check(
        """SELECT 'unique_key(split,row_id)' AS contract, COUNT(*) AS violations
           FROM (SELECT split, row_id FROM loans GROUP BY split, row_id HAVING COUNT(*) > 1)
           UNION ALL
           SELECT 'unique_key(grade)', COUNT(*) FROM (SELECT grade FROM loans GROUP BY grade HAVING COUNT(*) > 1)"""
    ),
)
def c17_unique_key(spark, sf_dir):
    loans = raw_loans(spark, sf_dir)
    return contracts.all_of(contracts.unique_key(loans, "split", "row_id"), contracts.unique_key(loans, "grade"))


@query(
    "c18_checkpoint_metrics",
    check(
        """SELECT 'clean' AS checkpoint_name, 'loans' AS dataset_name, COUNT(*) AS row_count, CAST(21 AS BIGINT) AS column_count,
           true AS id_present, CAST(COUNT(*) - COUNT(row_id) AS BIGINT) AS id_nulls, COUNT(*) = COUNT(DISTINCT row_id) AS id_unique,
           CAST(SUM(pymnt_plan) AS BIGINT) AS payment_plans FROM clean"""
    ),
)
def c18_checkpoint_metrics(spark, sf_dir):
    clean = clean_loans(raw_loans(spark, sf_dir))
    return cleaning.checkpoint_metrics(
        clean, "loans", "clean", "row_id", {"payment_plans": F.sum(F.col("pymnt_plan").cast("bigint"))}
    )


@query(
    "c18_checkpoint_metrics_observed",
    check(
        """SELECT 'clean' AS checkpoint_name, 'loans' AS dataset_name, COUNT(*) AS row_count,
           CAST(COUNT(*) - COUNT(row_id) AS BIGINT) AS id_nulls, COUNT(*) FILTER (WHERE pymnt_plan = 1) AS payment_plans,
           COUNT(*) FILTER (WHERE NOT (score BETWEEN 0 AND 1) OR score IS NULL) AS score_out_of_range FROM clean"""
    ),
)
def c18_checkpoint_metrics_observed(spark, sf_dir):
    """The clean layer written once; its checkpoint metrics are observed on that write, with no pass of their own."""
    clean = clean_loans(raw_loans(spark, sf_dir))
    got = contracts.observed_write(
        clean, shared_folder(spark, "clean-layer"), {"score_in_range": F.col("score").between(0, 1)}, "row_id",
        {"payment_plans": F.count_if(F.col("pymnt_plan") == 1)}, "clean",
    )
    row = {
        "checkpoint_name": "clean", "dataset_name": "loans", "row_count": got["rows"], "id_nulls": got["key_nulls"],
        "payment_plans": got["payment_plans"], "score_out_of_range": got["score_in_range"],
    }
    schema = "checkpoint_name string, dataset_name string, row_count bigint, id_nulls bigint, payment_plans bigint, score_out_of_range bigint"
    return local_table(spark, [row], schema)


@query(
    "contracts_row_checks",
    check(
        """SELECT 'known_split' AS contract, CAST(0 AS BIGINT) AS violations FROM (SELECT COUNT(*) FROM clean)
           UNION ALL SELECT 'dti_present', COUNT(*) - COUNT(dti) FROM clean
           UNION ALL SELECT 'income_positive', COUNT(*) FILTER (WHERE NOT annual_inc > 0) FROM clean
           UNION ALL SELECT 'score_in_range', COUNT(*) FILTER (WHERE NOT (score BETWEEN 0 AND 1)) FROM clean"""
    ),
)
def contracts_row_checks(spark, sf_dir):
    return contracts.row_checks(
        clean_loans(raw_loans(spark, sf_dir)),
        {
            "known_split": F.col("split").isin("train", "test"),
            "dti_present": F.col("dti").isNotNull(),
            "income_positive": F.col("annual_inc") > 0,
            "score_in_range": F.col("score").between(0, 1),
        },
    )


# --- cohort and exploratory tables ----------------------------------------------------------


@query("d1_terminal_cohort", check("SELECT split, row_id, loan_status FROM m"))
def d1_terminal_cohort(spark, sf_dir):
    return cohort.terminal(clean_loans(raw_loans(spark, sf_dir))).select("split", "row_id", "loan_status")


@query(
    "d2_target",
    check("SELECT split, row_id, CAST(loan_status LIKE '%charged_off' AS BIGINT) AS target_default FROM clean"),
)
def d2_target(spark, sf_dir):
    return cohort.with_target(clean_loans(raw_loans(spark, sf_dir))).select("split", "row_id", "target_default")


_SUMMARY = f"""SELECT split, COUNT(*) AS rows, {n('SUM(target_default)')} AS default_count,
    {n('SUM(1 - target_default)')} AS non_default_count, {r('AVG(target_default)')} AS default_rate FROM m GROUP BY split"""


@query("d3_cohort_summary", check(_SUMMARY))
def d3_cohort_summary(spark, sf_dir):
    return rounded(cohort.cohort_summary(modeled_loans(raw_loans(spark, sf_dir))))


@query(
    "d3_cohort_summary_percent",
    check(
        f"""SELECT split AS dataset_split, COUNT(*) AS loan_count, {n('SUM(target_default)')} AS default_count,
        {n('SUM(1 - target_default)')} AS non_default_count, ROUND(AVG(target_default) * 100, 2) AS default_rate_percent
        FROM m GROUP BY split"""
    ),
)
def d3_cohort_summary_percent(spark, sf_dir):
    return cohort.cohort_summary_percent(cohort.cohort_summary(modeled_loans(raw_loans(spark, sf_dir))))


@query(
    "d4_population_by_stage",
    check(
        """SELECT 'feature_base' AS population_stage, split AS dataset_split, COUNT(*) AS rows, CAST(16 AS BIGINT) AS columns FROM clean GROUP BY split
           UNION ALL SELECT 'terminal_cohort', split, COUNT(*), CAST(17 AS BIGINT) FROM m GROUP BY split"""
    ),
)
def d4_population_by_stage(spark, sf_dir):
    base = cleaning.project_layer(clean_loans(raw_loans(spark, sf_dir)), EXCLUDED, BENCHMARK)
    return cohort.population_by_stage(base, cohort.with_target(cohort.terminal(base)))


@query(
    "d5_target_distribution",
    check(
        f"""SELECT split AS dataset_split, {n('SUM(target_default)')} AS positive_count,
        COUNT(*) FILTER (WHERE target_default = 0) AS negative_count,
        ROUND(AVG(target_default) * 100, 2) AS default_rate_percent FROM m GROUP BY split"""
    ),
)
def d5_target_distribution(spark, sf_dir):
    return cohort.target_distribution(modeled_loans(raw_loans(spark, sf_dir)))


@query("d6_issue_year", check("SELECT split, row_id, CAST(YEAR(issue_d) AS BIGINT) AS issue_year FROM clean"))
def d6_issue_year(spark, sf_dir):
    dated = clean_loans(raw_loans(spark, sf_dir)).drop("issue_year")
    return cohort.with_issue_year(dated).select("split", "row_id", "issue_year")


_PLAIN = ["charged_off", "current", "fully_paid"]
_STATUSES = [*_PLAIN, *[f"does_not_meet_the_credit_policy._status:{s}" for s in _PLAIN]]


@query(
    "d7_status_by_year",
    check(
        "SELECT split AS dataset_split, issue_year, "
        + ", ".join(f"COUNT(*) FILTER (WHERE loan_status = '{s}') AS \"{s}\"" for s in _STATUSES)
        + ", COUNT(*) AS all_loans FROM clean GROUP BY split, issue_year"
    ),
)
def d7_status_by_year(spark, sf_dir):
    table = cohort.status_by_year(clean_loans(raw_loans(spark, sf_dir)), _STATUSES)
    return table.withColumn("all_loans", sum((F.col(f"`{s}`") for s in _STATUSES), F.lit(0).cast("bigint")))


_RATE_BY_YEAR = """rate_by_year AS (SELECT issue_year, split AS dataset_split, ROUND(AVG(target_default) * 100, 2) AS default_rate_percent,
    COUNT(*) AS loan_count FROM m GROUP BY issue_year, split)"""


@query("d8_default_rate_by_year", check("SELECT * FROM rate_by_year", _RATE_BY_YEAR))
def d8_default_rate_by_year(spark, sf_dir):
    return cohort.default_rate_by_year(modeled_loans(raw_loans(spark, sf_dir)))


@query(
    "d9_volume_by_year",
    check("SELECT issue_year, split AS dataset_split, COUNT(*) AS loan_count FROM clean GROUP BY issue_year, split"),
)
def d9_volume_by_year(spark, sf_dir):
    return cohort.volume_by_year(clean_loans(raw_loans(spark, sf_dir)))


_SPARSE = ["dti", "revol_bal", "emp_length", "mths_since_last_delinq"]
_MISSING_SQL = "missing AS (" + " UNION ALL ".join(
    f"""SELECT issue_year, split AS dataset_split, '{c}' AS feature_name,
        ROUND(AVG(CAST({c} IS NULL AS DOUBLE)) * 100, 2) AS missing_percent FROM loans GROUP BY issue_year, split"""
    for c in _SPARSE
) + ")"


@query(
    "d10_missingness_by_year",
    check("SELECT *, CONCAT(dataset_split, ' — ', feature_name) AS series_label FROM missing", _MISSING_SQL),
)
def d10_missingness_by_year(spark, sf_dir):
    return cohort.missingness_by_year(raw_loans(spark, sf_dir), _SPARSE)


@query(
    "d11_reporting_shift",
    check(
        """SELECT dataset_split, feature_name, MIN(missing_percent) AS min_missing_percent,
           MAX(missing_percent) AS max_missing_percent FROM missing GROUP BY dataset_split, feature_name""",
        _MISSING_SQL,
    ),
)
def d11_reporting_shift(spark, sf_dir):
    return cohort.reporting_shift(cohort.missingness_by_year(raw_loans(spark, sf_dir), _SPARSE))


@query(
    "d12_missingness_by_split",
    check(
        " UNION ALL ".join(
            f"""SELECT split AS dataset_split, '{c}' AS feature_name,
            ROUND(AVG(CAST({c} IS NULL AS DOUBLE)) * 100, 2) AS missing_percent FROM loans GROUP BY split"""
            for c in _SPARSE
        )
    ),
)
def d12_missingness_by_split(spark, sf_dir):
    return cohort.missingness_by_split(raw_loans(spark, sf_dir), _SPARSE)


_BINNED = ["annual_inc", "dti", "loan_amnt", "open_acc"]
_TENTHS = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"
_QUANTILE_SQL = (
    "long AS ("
    + " UNION ALL ".join(
        f"SELECT split, '{c}' AS feature_name, CAST({c} AS DOUBLE) AS v, target_default AS y FROM m WHERE {c} IS NOT NULL"
        for c in _BINNED
    )
    + ")",
    f"""edge_list AS (SELECT feature_name, list_sort(list_distinct(quantile_cont(v, {_TENTHS}))) AS edges
        FROM long WHERE split = 'train' GROUP BY feature_name)""",
    """spine AS (SELECT feature_name, unnest(range(1, len(edges))) AS bin, edges FROM edge_list)""",
    """binned AS (SELECT l.split, l.feature_name, l.y,
        1 + len(list_filter(edges[2:len(edges) - 1], lambda e: e < l.v)) AS bin
        FROM long l JOIN edge_list USING (feature_name) WHERE l.v >= edges[1] AND l.v <= edges[len(edges)])""",
    f"""quantile_rates AS (SELECT s.feature_name, d.dataset_split, {n('s.bin')} AS bin, {r('s.edges[s.bin]')} AS bin_low,
        {r('s.edges[s.bin + 1]')} AS bin_high, COUNT(b.y) AS loan_count, ROUND(AVG(b.y) * 100, 2) AS default_rate_percent
        FROM spine s JOIN (VALUES ('train'), ('test')) d(dataset_split) ON true
        LEFT JOIN binned b ON b.feature_name = s.feature_name AND b.bin = s.bin AND b.split = d.dataset_split
        GROUP BY ALL)""",
)


def _quantile_rates(spark, sf_dir):
    loans = stored_loans(spark, sf_dir, "split", "target_default", *_BINNED)
    return rounded(cohort.rate_by_train_quantile(loans, _BINNED))


@query("d13_rate_by_quantile", check("SELECT * FROM quantile_rates", *_QUANTILE_SQL))
def d13_rate_by_quantile(spark, sf_dir):
    return _quantile_rates(spark, sf_dir).drop("feature_bin")


def _category_sql(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature_name, split AS dataset_split, COALESCE(CAST({feature} AS VARCHAR), 'missing') AS category,
        COUNT(*) AS loan_count, ROUND(AVG(target_default) * 100, 2) AS default_rate_percent FROM m GROUP BY ALL"""


@query("d14_rate_by_category", check(_category_sql("emp_length_years") + " UNION ALL " + _category_sql("purpose")))
def d14_rate_by_category(spark, sf_dir):
    modeled = modeled_loans(raw_loans(spark, sf_dir))
    return cohort.rate_by_category(modeled, "emp_length_years").unionByName(cohort.rate_by_category(modeled, "purpose"))


@query(
    "d14_rate_by_missingness",
    check(
        """SELECT 'dti' AS feature_name, split AS dataset_split, CASE WHEN dti IS NULL THEN 'missing' ELSE 'not_missing' END AS category,
        COUNT(*) AS loan_count, ROUND(AVG(target_default) * 100, 2) AS default_rate_percent FROM m GROUP BY ALL"""
    ),
)
def d14_rate_by_missingness(spark, sf_dir):
    return cohort.rate_by_category(modeled_loans(raw_loans(spark, sf_dir)), "dti", as_missingness=True)


@query(
    "d15_volume_by_category",
    check(
        """SELECT split AS dataset_split, COALESCE(emp_length, 'missing') AS category, COUNT(*) AS loan_count
           FROM loans GROUP BY ALL"""
    ),
)
def d15_volume_by_category(spark, sf_dir):
    return cohort.volume_by_category(raw_loans(spark, sf_dir), "emp_length")


@query(
    "d16_stacked_tables",
    check(
        f"""SELECT feature_name, dataset_split, CAST(bin AS VARCHAR) AS feature_bin, loan_count, default_rate_percent FROM quantile_rates
            UNION ALL SELECT feature_name, dataset_split, category, loan_count, default_rate_percent FROM ({_category_sql('purpose')})""",
        *_QUANTILE_SQL,
    ),
)
def d16_stacked_tables(spark, sf_dir):
    modeled = modeled_loans(raw_loans(spark, sf_dir))
    bins = cohort.rate_by_train_quantile(modeled, _BINNED).withColumn("feature_bin", F.col("bin").cast("string"))
    stacked = cohort.stack_rate_tables(bins.drop("bin", "bin_low", "bin_high"), cohort.rate_by_category(modeled, "purpose"))
    return stacked.select("feature_name", "dataset_split", "feature_bin", "loan_count", "default_rate_percent")


@query(
    "d17_cashflow_coherence",
    check(
        """SELECT split AS dataset_split, loan_status, ROUND(AVG(loan_amnt), 2) AS loan_amnt, ROUND(AVG(annual_inc), 2) AS annual_inc,
           ROUND(AVG(revol_bal), 2) AS revol_bal, ROUND(AVG(open_acc), 2) AS open_acc FROM clean GROUP BY ALL"""
    ),
)
def d17_cashflow_coherence(spark, sf_dir):
    clean = clean_loans(raw_loans(spark, sf_dir))
    return cohort.cashflow_coherence(clean, "loan_status", ["loan_amnt", "annual_inc", "revol_bal", "open_acc"])
