"""The loan view over the driver tables, its cleaned layer and its modeled cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tranche.functions import text
from tranche.operators import cleaning, cohort
from tranche.plans.session import utc, written_once

# Order years before this one form the train split.
FIRST_TEST_YEAR = 2000
# Recency columns of the loan view, with the code for "never happened".
RECENCY_COLUMNS = ["mths_since_last_delinq"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw-style loan row per order. Line items are summed per order before the join."""
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("open_acc"),
            F.round(F.avg("l_discount") * 100, 2).alias("dti"),
            F.max("l_quantity").alias("revol_bal"),
        )
    )
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        items, orders.o_orderkey == items.l_orderkey, "left"
    )
    order_key, customer_key = F.col("o_orderkey"), F.col("o_custkey")
    year, is_train = F.year("o_orderdate"), F.year("o_orderdate") < FIRST_TEST_YEAR
    grade = F.substring(F.lit("ABCDEFG"), (customer_key % 7 + 1).cast("int"), F.lit(1))
    employment = customer_key % 13
    home = customer_key % 6
    month = F.element_at(F.array(*[F.lit(m) for m in text.MONTH_NAMES]), F.month("o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "F", "Fully Paid").when(F.col("o_orderstatus") == "P", "Charged Off")
    exception = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & is_train
    return joined.select(
        order_key.cast("bigint").alias("row_id"),
        F.when(is_train, "train").otherwise("test").alias("split"),
        year.cast("bigint").alias("issue_year"),
        F.concat_ws("-", month, year.cast("string")).alias("issue_d"),
        F.col("o_totalprice").alias("loan_amnt"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("annual_inc"),
        F.concat(
            F.when(exception, "Does not meet the credit policy. Status:").otherwise(""), status.otherwise("Current")
        ).alias("loan_status"),
        grade.alias("grade"),
        F.concat(grade, (order_key % 5 + 1).cast("string")).alias("sub_grade"),
        F.concat(
            (5 + customer_key % 20).cast("string"),
            F.lit("."),
            F.lpad((order_key % 100).cast("string"), 2, "0"),
            F.lit("%"),
        ).alias("int_rate"),
        F.when(order_key % 2 == 0, " 36 months").otherwise(" 60 months").alias("term"),
        F.when(employment == 0, "< 1 year")
        .when(employment == 1, "1 year")
        .when(employment < 10, F.concat(employment.cast("string"), F.lit(" years")))
        .when(employment == 10, "10+ years")
        .when(employment == 11, "n/a")
        .alias("emp_length"),
        F.when(home == 0, "RENT")
        .when(home == 1, " Own ")
        .when(home == 2, "MORTGAGE")
        .when((home == 3) & is_train, "NONE")
        .when(home == 4, "ANY")
        .otherwise("OTHER")
        .alias("home_ownership"),
        F.concat("c_mktsegment", F.lit("  Goods")).alias("purpose"),
        F.when(order_key % 10 == 0, "y").otherwise("n").alias("pymnt_plan"),
        F.when(order_key % 3 != 0, (customer_key % 120).cast("double")).alias("mths_since_last_delinq"),
        "open_acc",
        "dti",
        "revol_bal",
        (((customer_key * 7919 + order_key * 104729) % 10000).cast("double") / 10000.0).alias("score"),
    )


def clean_loans(loans: DataFrame) -> DataFrame:
    """The clean layer: sentinel flags, normal text, numbers and months as typed columns."""
    df = cleaning.sentinel(loans, RECENCY_COLUMNS)
    df = cleaning.normalise_text(df, ["loan_status", "grade", "sub_grade", "purpose"])
    df = cleaning.collapse_home_ownership(df)
    df = cleaning.normalise_text(df, ["home_ownership"])
    df = cleaning.map_values(df, "pymnt_plan", cleaning.PAYMENT_PLAN_CODES)
    df = cleaning.term_months(df)
    df = cleaning.employment_years(df)
    df = cleaning.parse_months(df, ["issue_d"])
    df = cleaning.percent_to_double(df, ["int_rate"])
    return df.drop("term", "emp_length")


def modeled_loans(loans: DataFrame) -> DataFrame:
    """Terminal loans of the clean layer with their 0/1 target."""
    return cohort.with_target(cohort.terminal(clean_loans(loans)))


def stored_loans(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the modeled loans, written once below the shared folder: for plans that fit first and apply then."""
    modeled = modeled_loans(raw_loans(spark, sf_dir))
    return written_once(modeled.select(*columns) if columns else modeled, "modeled")


def train_of(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train").drop("split")


def test_of(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "test").drop("split")
