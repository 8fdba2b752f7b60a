"""Terminal cohort, target, and default-rate tables by year, category and quantile bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.functions.guards import ensure, require_columns
from tranche.operators import ordered

# Cleaned loan statuses with a known outcome.
TERMINAL_STATUSES = [
    "fully_paid",
    "charged_off",
    "default",
    "does_not_meet_the_credit_policy._status:fully_paid",
    "does_not_meet_the_credit_policy._status:charged_off",
]
POSITIVE_STATUSES = [
    "charged_off",
    "default",
    "does_not_meet_the_credit_policy._status:charged_off",
]
SPLITS = ["train", "test"]


def split_rank(column: str = "split", order: Sequence[str] = tuple(SPLITS)):
    """Sort key: train before test, anything else last."""
    rank = F.when(F.col(column) == order[0], 0)
    for i, name in enumerate(order[1:], start=1):
        rank = rank.when(F.col(column) == name, i)
    return rank.otherwise(len(order))


def percent_of(flag, digits: int = 2):
    """Rounded mean of a 0/1 expression, in percent."""
    return F.round(F.avg(flag.cast("double")) * 100, digits)


def terminal(df: DataFrame, status: str = "loan_status", statuses: Sequence[str] = tuple(TERMINAL_STATUSES)) -> DataFrame:
    require_columns(df, status)
    return df.filter(F.col(status).isin(list(statuses)))


def with_target(
    df: DataFrame,
    status: str = "loan_status",
    positive: Sequence[str] = tuple(POSITIVE_STATUSES),
    target: str = "target_default",
) -> DataFrame:
    require_columns(df, status)
    return df.withColumn(target, F.coalesce(F.col(status).isin(list(positive)), F.lit(False)).cast("bigint"))


def cohort_summary(df: DataFrame, target: str = "target_default", split: str = "split") -> DataFrame:
    require_columns(df, target, split)
    return (
        df.groupBy(split)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(target).alias("default_count"),
            F.sum(1 - F.col(target)).alias("non_default_count"),
            F.avg(target).alias("default_rate"),
        )
        .orderBy(split_rank(split))
    )


def cohort_summary_percent(summary: DataFrame, split: str = "split") -> DataFrame:
    """The report view of :func:`cohort_summary` with the rate in percent."""
    return summary.select(
        F.col(split).alias("dataset_split"),
        F.col("rows").alias("loan_count"),
        "default_count",
        "non_default_count",
        F.round(F.col("default_rate") * 100, 2).alias("default_rate_percent"),
    )


def population_by_stage(feature_base: DataFrame, cohort_df: DataFrame, split: str = "split") -> DataFrame:
    """Rows and columns of the feature base and the terminal cohort, per split."""
    parts = [
        df.groupBy(split)
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.lit(stage).alias("population_stage"),
            F.col(split).alias("dataset_split"),
            "rows",
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
        )
        for stage, df in (("feature_base", feature_base), ("terminal_cohort", cohort_df))
    ]
    return parts[0].unionByName(parts[1]).orderBy("population_stage", split_rank("dataset_split"))


def target_distribution(df: DataFrame, target: str = "target_default", split: str = "split") -> DataFrame:
    require_columns(df, target, split)
    return (
        df.groupBy(F.col(split).alias("dataset_split"))
        .agg(
            F.sum(target).alias("positive_count"),
            F.count_if(F.col(target) == 0).alias("negative_count"),
            percent_of(F.col(target)).alias("default_rate_percent"),
        )
        .orderBy(split_rank("dataset_split"))
    )


def with_issue_year(df: DataFrame, date: str = "issue_d", output: str = "issue_year") -> DataFrame:
    require_columns(df, date)
    return df.withColumn(output, F.year(F.col(date).try_cast("timestamp")).cast("bigint"))


def status_by_year(
    df: DataFrame, statuses: Sequence[str] | None = None, year: str = "issue_year", status: str = "loan_status",
    split: str = "split",
) -> DataFrame:
    """Zero-filled crosstab of every status. A given list saves the pass that finds them; one outside it fails the job."""
    if statuses is None:
        statuses = sorted(r[0] for r in df.select(status).distinct().collect() if r[0] is not None)
    listed = ensure(F.col(status).isin(*statuses), F.col(status), F.concat(F.lit("unlisted status: "), F.coalesce(status, F.lit("null"))))
    return (
        df.select(F.col(split).alias("dataset_split"), year, listed.alias(status))
        .groupBy("dataset_split", year)
        .pivot(status, list(statuses))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .orderBy(split_rank("dataset_split"), year)
    )


def default_rate_by_year(
    df: DataFrame, year: str = "issue_year", target: str = "target_default", split: str = "split"
) -> DataFrame:
    return (
        df.filter(F.col(year).isNotNull())
        .groupBy(year, F.col(split).alias("dataset_split"))
        .agg(percent_of(F.col(target)).alias("default_rate_percent"), F.count(F.lit(1)).alias("loan_count"))
        .orderBy(split_rank("dataset_split"), year)
    )


def volume_by_year(df: DataFrame, year: str = "issue_year", split: str = "split") -> DataFrame:
    return (
        df.filter(F.col(year).isNotNull())
        .groupBy(year, F.col(split).alias("dataset_split"))
        .agg(F.count(F.lit(1)).alias("loan_count"))
        .orderBy(split_rank("dataset_split"), year)
    )


def missingness_by_year(
    df: DataFrame, columns: Sequence[str], year: str = "issue_year", split: str = "split"
) -> DataFrame:
    """Percent null per (year, feature): one grouped pass over all columns, then unpivot."""
    require_columns(df, *columns)
    wide = (
        df.filter(F.col(year).isNotNull())
        .groupBy(year, F.col(split).alias("dataset_split"))
        .agg(*[percent_of(F.col(c).isNull()).alias(c) for c in columns])
    )
    return wide.unpivot([year, "dataset_split"], list(columns), "feature_name", "missing_percent").withColumn(
        "series_label", F.concat_ws(" — ", "dataset_split", "feature_name")
    )


def reporting_shift(missingness: DataFrame) -> DataFrame:
    return (
        missingness.groupBy("dataset_split", "feature_name")
        .agg(
            F.min("missing_percent").alias("min_missing_percent"),
            F.max("missing_percent").alias("max_missing_percent"),
        )
        .orderBy(split_rank("dataset_split"), "feature_name")
    )


def missingness_by_split(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    require_columns(df, *columns)
    wide = df.groupBy(F.col(split).alias("dataset_split")).agg(
        *[percent_of(F.col(c).isNull()).alias(c) for c in columns]
    )
    return wide.unpivot(["dataset_split"], list(columns), "feature_name", "missing_percent")


def rate_by_train_quantile(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str = "target_default",
    bins: int = 10,
    split: str = "split",
    train_label: str = "train",
) -> DataFrame:
    """Default rate per train-fitted quantile bin, for any number of features in one pass.

    Edges come from the train split; equal edges are merged and at least three must remain.
    Rows of either split outside the edges drop out; empty bins stay with count 0.
    """
    features = [features] if isinstance(features, str) else list(features)
    require_columns(df, *features, target, split)
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    # The train filter comes before the unpivot, so that every reader of the train values shares one plan.
    train = df.filter(F.col(split) == train_label).select(*numbers).unpivot([], features, "feature_name", "value")
    edges = ordered.bin_edges(train, ["feature_name"], "value", bins)
    long = df.select(split, target, *numbers).unpivot([split, target], features, "feature_name", "value")
    edges = edges.withColumn(
        "edges",
        ensure(F.size("edges") >= 3, F.col("edges"), F.concat(F.lit("too few distinct edges: "), F.col("feature_name"))),
    )
    counted = (
        ordered.with_bin(long, edges, ["feature_name"], "value", bins)
        .filter(F.col("bin").isNotNull())
        .groupBy(split, "feature_name", "bin")
        .agg(F.count(F.lit(1)).alias("loan_count"), percent_of(F.col(target)).alias("default_rate_percent"))
    )
    spine = ordered.bin_spine(edges, ["feature_name"]).withColumn(
        split, F.explode(F.array(*[F.lit(s) for s in SPLITS]))
    )
    return spine.join(counted, [split, "feature_name", "bin"], "left").select(
        "feature_name",
        F.col(split).alias("dataset_split"),
        F.col("bin").cast("bigint").alias("bin"),
        "bin_low",
        "bin_high",
        ordered.bin_label().alias("feature_bin"),
        F.coalesce("loan_count", F.lit(0)).alias("loan_count"),
        "default_rate_percent",
    )


def _category(feature: str, missing_flag: bool = False):
    c = F.col(feature)
    if missing_flag:
        return F.when(c.isNull(), "missing").otherwise("not_missing")
    return F.coalesce(c.cast("string"), F.lit("missing"))


def rate_by_category(
    df: DataFrame, feature: str, target: str = "target_default", split: str = "split", as_missingness: bool = False
) -> DataFrame:
    require_columns(df, feature, target, split)
    return (
        df.groupBy(F.col(split).alias("dataset_split"), _category(feature, as_missingness).alias("category"))
        .agg(F.count(F.lit(1)).alias("loan_count"), percent_of(F.col(target)).alias("default_rate_percent"))
        .select(F.lit(feature).alias("feature_name"), "dataset_split", "category", "loan_count", "default_rate_percent")
        .orderBy(split_rank("dataset_split"), "category")
    )


def volume_by_category(df: DataFrame, feature: str, split: str = "split") -> DataFrame:
    require_columns(df, feature, split)
    return (
        df.groupBy(F.col(split).alias("dataset_split"), _category(feature).alias("category"))
        .agg(F.count(F.lit(1)).alias("loan_count"))
        .orderBy(split_rank("dataset_split"), F.desc("loan_count"), "category")
    )


def stack_rate_tables(*tables: DataFrame, key: str = "feature_bin") -> DataFrame:
    """Union of quantile and category rate tables; the category becomes the bin text."""
    from functools import reduce

    renamed = [t.withColumnRenamed("category", key) if key not in t.columns else t for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)


def cashflow_coherence(df: DataFrame, group: str, values: Sequence[str], split: str = "split") -> DataFrame:
    """Group means of the cash-flow columns per split, train first."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(F.col(split).alias("dataset_split"), group)
        .agg(*[F.round(F.avg(v), 2).alias(v) for v in values])
        .orderBy(split_rank("dataset_split"), group)
    )
