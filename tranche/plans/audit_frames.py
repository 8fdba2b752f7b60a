"""Two loan frames with the usual differences between extracts, for audits and drift reports.

The train frame lacks a column of the test frame and the other way round, one number has another
type, one column is constant and one is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.operators import features
from tranche.plans.loans import raw_loans, test_of, train_of

TYPES = {
    "row_id": "bigint",
    "issue_year": "bigint",
    "issue_d": "string",
    "loan_amnt": "double",
    "annual_inc": "double",
    "loan_status": "string",
    "grade": "string",
    "sub_grade": "string",
    "int_rate": "string",
    "term": "string",
    "emp_length": "string",
    "home_ownership": "string",
    "purpose": "string",
    "pymnt_plan": "string",
    "mths_since_last_delinq": "double",
    "open_acc": "bigint",
    "dti": "double",
    "revol_bal": "double",
    "score": "double",
    "policy_code": "bigint",
    "annual_inc_joint": "double",
}
TRAIN_TYPES = {c: t for c, t in TYPES.items() if c != "pymnt_plan"}
TEST_TYPES = {c: ("double" if c == "open_acc" else t) for c, t in TYPES.items() if c != "emp_length"}


def _with_oddities(df: DataFrame) -> DataFrame:
    return df.withColumns({"policy_code": F.lit(1).cast("bigint"), "annual_inc_joint": F.lit(None).cast("double")})


def audit_train(spark, sf_dir) -> DataFrame:
    return _with_oddities(train_of(raw_loans(spark, sf_dir))).drop("pymnt_plan")


def audit_test(spark, sf_dir) -> DataFrame:
    df = _with_oddities(test_of(raw_loans(spark, sf_dir))).drop("emp_length")
    return df.withColumn("open_acc", F.col("open_acc").cast("double"))


def with_nulls(compared: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Add how many nulls each compared column holds on either side."""
    sides = [
        features.null_counts(df).select("column_name", F.col("null_count").alias(f"{name}_nulls"))
        for name, df in (("train", train), ("test", test))
    ]
    return compared.join(sides[0], "column_name", "left").join(sides[1], "column_name", "left")


# --- the same frames in SQL -----------------------------------------------------------------

FRAMES_SQL = (
    """atrain AS (SELECT * EXCLUDE (split, pymnt_plan), CAST(1 AS BIGINT) AS policy_code, CAST(NULL AS DOUBLE) AS annual_inc_joint
       FROM loans WHERE split = 'train')""",
    """atest AS (SELECT * EXCLUDE (split, emp_length) REPLACE (CAST(open_acc AS DOUBLE) AS open_acc),
       CAST(1 AS BIGINT) AS policy_code, CAST(NULL AS DOUBLE) AS annual_inc_joint FROM loans WHERE split = 'test')""",
    "train_types(column_name, dtype) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in TRAIN_TYPES.items()) + ")",
    "test_types(column_name, dtype) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in TEST_TYPES.items()) + ")",
    *[
        f"""{s}_long AS (SELECT column_name, value FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM a{s})
            UNPIVOT INCLUDE NULLS (value FOR column_name IN (COLUMNS(*))))"""
        for s in ("train", "test")
    ],
)

NULLS_SQL = (
    *FRAMES_SQL,
    """schema_nulls AS (SELECT column_name, a.dtype AS train_dtype, b.dtype AS test_dtype,
        a.dtype IS NOT NULL AS present_in_train, b.dtype IS NOT NULL AS present_in_test,
        COALESCE(a.dtype <> b.dtype, false) AS dtype_mismatch,
        x.nulls AS train_nulls, y.nulls AS test_nulls
        FROM train_types a FULL JOIN test_types b USING (column_name)
        LEFT JOIN (SELECT column_name, COUNT(*) - COUNT(value) AS nulls FROM train_long GROUP BY 1) x USING (column_name)
        LEFT JOIN (SELECT column_name, COUNT(*) - COUNT(value) AS nulls FROM test_long GROUP BY 1) y USING (column_name))""",
)
