"""Registry of catalogue queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# The loan view, its clean layer and its modeled cohort in portable SQL, independent of the Spark plans.
BASE_SQL = r"""
WITH li AS (
  SELECT l_orderkey, COUNT(*) AS n_items, ROUND(AVG(l_discount) * 100, 2) AS disc_pct,
         MAX(l_quantity) AS max_qty
  FROM lineitem GROUP BY l_orderkey),
loans AS (
SELECT
  CAST(o_orderkey AS BIGINT) AS row_id,
  CASE WHEN YEAR(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS split,
  CAST(YEAR(o_orderdate) AS BIGINT) AS issue_year,
  CONCAT(SUBSTR('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(MONTH(o_orderdate) * 3 - 2 AS INT), 3),
         '-', CAST(YEAR(o_orderdate) AS VARCHAR(4))) AS issue_d,
  o_totalprice AS loan_amnt,
  GREATEST(c_acctbal, 0.0) AS annual_inc,
  CONCAT(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND YEAR(o_orderdate) < 2000
              THEN 'Does not meet the credit policy. Status:' ELSE '' END,
         CASE o_orderstatus WHEN 'F' THEN 'Fully Paid' WHEN 'P' THEN 'Charged Off' ELSE 'Current' END) AS loan_status,
  SUBSTR('ABCDEFG', CAST(o_custkey % 7 AS INT) + 1, 1) AS grade,
  CONCAT(SUBSTR('ABCDEFG', CAST(o_custkey % 7 AS INT) + 1, 1), CAST(o_orderkey % 5 + 1 AS VARCHAR(1))) AS sub_grade,
  CONCAT(CAST(5 + o_custkey % 20 AS VARCHAR(2)), '.', LPAD(CAST(o_orderkey % 100 AS VARCHAR(2)), 2, '0'), '%') AS int_rate,
  CASE WHEN o_orderkey % 2 = 0 THEN ' 36 months' ELSE ' 60 months' END AS term,
  CASE WHEN o_custkey % 13 = 0 THEN '< 1 year' WHEN o_custkey % 13 = 1 THEN '1 year'
       WHEN o_custkey % 13 < 10 THEN CONCAT(CAST(o_custkey % 13 AS VARCHAR(1)), ' years')
       WHEN o_custkey % 13 = 10 THEN '10+ years' WHEN o_custkey % 13 = 11 THEN 'n/a' END AS emp_length,
  CASE WHEN o_custkey % 6 = 0 THEN 'RENT' WHEN o_custkey % 6 = 1 THEN ' Own ' WHEN o_custkey % 6 = 2 THEN 'MORTGAGE'
       WHEN o_custkey % 6 = 3 AND YEAR(o_orderdate) < 2000 THEN 'NONE' WHEN o_custkey % 6 = 4 THEN 'ANY' ELSE 'OTHER' END AS home_ownership,
  CONCAT(c_mktsegment, '  Goods') AS purpose,
  CASE WHEN o_orderkey % 10 = 0 THEN 'y' ELSE 'n' END AS pymnt_plan,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 120 AS DOUBLE) END AS mths_since_last_delinq,
  CAST(n_items AS BIGINT) AS open_acc, disc_pct AS dti, max_qty AS revol_bal,
  CAST((o_custkey * 7919 + o_orderkey * 104729) % 10000 AS DOUBLE) / 10000.0 AS score
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN li ON l_orderkey = o_orderkey),
clean AS (
SELECT row_id, split, issue_year, strptime(issue_d, '%b-%Y') AS issue_d, loan_amnt, annual_inc,
  REPLACE(REGEXP_REPLACE(LOWER(TRIM(loan_status)), '\s+', ' ', 'g'), ' ', '_') AS loan_status,
  LOWER(grade) AS grade, LOWER(sub_grade) AS sub_grade,
  CAST(REPLACE(int_rate, '%', '') AS DOUBLE) AS int_rate,
  CASE WHEN LOWER(TRIM(home_ownership)) IN ('none', 'any') THEN 'other' ELSE LOWER(TRIM(home_ownership)) END AS home_ownership,
  REPLACE(REGEXP_REPLACE(LOWER(TRIM(purpose)), '\s+', ' ', 'g'), ' ', '_') AS purpose,
  CAST(pymnt_plan = 'y' AS INT) AS pymnt_plan,
  COALESCE(mths_since_last_delinq, 9999) AS mths_since_last_delinq,
  open_acc, dti, revol_bal, score,
  CAST(mths_since_last_delinq IS NOT NULL AS TINYINT) AS has_mths_since_last_delinq,
  CAST(REGEXP_EXTRACT(term, '(\d+)', 1) AS SMALLINT) AS term_months,
  CAST(CASE WHEN emp_length = '< 1 year' THEN 0 WHEN emp_length = 'n/a' THEN NULL
            ELSE CAST(REGEXP_EXTRACT(emp_length, '(\d+)', 1) AS INT) END AS FLOAT) AS emp_length_years
FROM loans),
m AS (
SELECT *, CAST(loan_status LIKE '%charged_off' AS BIGINT) AS target_default
FROM clean
WHERE loan_status LIKE '%fully_paid' OR loan_status LIKE '%charged_off')
"""


def check(select: str, *tables: str) -> str:
    """Check SQL: the base tables, any further ``name AS (...)`` tables, and the final select."""
    return ", ".join([BASE_SQL, *tables]) + "\n" + select


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its catalogue name with the SQL that checks it."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column: sums of doubles depend on their order in the last digits."""
    return df.select(
        *[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def r(expression: str, digits: int = 6) -> str:
    return f"ROUND(CAST({expression} AS DOUBLE), {digits})"


def n(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"
