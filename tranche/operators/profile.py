"""Column profiles: one grouped pass for plain statistics, one value-count table for the rest.

Distinct counts, samples and medians all come from ``value_counts``: (column_name, value, n).
Counting a value before anything else makes a heavy value one row, and the many exact
distinct counts of a wide table become a single shuffle instead of one per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tranche.functions.guards import ensure, require_columns
from tranche.functions.shape import local_table, record, rows_of
from tranche.functions.text import strip
from tranche.operators import ordered
from tranche.operators.cohort import SPLITS, split_rank
from tranche.plans.session import written_once

# Types whose values are exact in a double; bigint and decimal keep their own text.
_DOUBLE_SAFE = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _percent_null(nulls, total):
    return F.round(nulls / total * 100, 2)


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, value, number, n), nulls counted as a value of their own.

    ``number`` is the value as a double for numeric columns, null otherwise. One scan and one shuffle
    serve all columns: each value travels in the slot of its type, so numbers are compared as numbers
    and turned into text once per distinct value.
    """
    require_columns(df, *columns, *by)
    types = {f.name: f.dataType for f in df.schema.fields}
    slots = {"number": "double", "whole": "bigint", "text": "string"}
    slot_of = {
        c: "number" if isinstance(types[c], _DOUBLE_SAFE) else "whole" if isinstance(types[c], T.LongType) else "text"
        for c in columns
    }
    used = [s for s in slots if s in slot_of.values()]

    def in_slot(c: str) -> Column:
        fields = {s: F.col(c).cast(slots[s]) if s == slot_of[c] else F.lit(None).cast(slots[s]) for s in used}
        return record(column_name=c, **fields)

    long = rows_of(df, by, [in_slot(c) for c in columns])
    counted = long.groupBy(*by, "column_name", *used).agg(F.count(F.lit(1)).alias("n"))
    decimals = [c for c in columns if isinstance(types[c], T.DecimalType)]
    numbers = [F.col(s).cast("double") for s in used if s != "text"]
    if decimals:
        numbers.append(F.when(F.col("column_name").isin(decimals), F.col("text").try_cast("double")))
    return counted.select(
        *by,
        "column_name",
        F.coalesce(*[F.col(s).cast("string") for s in used]).alias("value"),
        (F.coalesce(*numbers) if numbers else F.lit(None).cast("double")).alias("number"),
        "n",
    )


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, dtype, position): the schema as a table."""
    wanted = list(df.columns if columns is None else columns)
    types = dict(df.dtypes)
    rows = [{"column_name": c, "dtype": types[c], "position": i} for i, c in enumerate(df.columns) if c in wanted]
    return local_table(df.sparkSession, rows, "column_name string, dtype string, position int")


def smallest_values(counts: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, sample_values): the k smallest distinct stripped values as an array.

    First-seen order does not exist in a distributed scan, so samples are the smallest values.
    The rank filter lets every task keep only its own k before the shuffle.
    """
    keys = [*by, "column_name"]
    stripped = counts.filter(F.col("value").isNotNull()).select(*keys, strip(F.col("value")).alias("value")).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("value"))
    return (
        stripped.withColumn("_rank", rank)
        .filter(F.col("_rank") <= k)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    )


def _folded(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per column: rows, nulls, distinct values with and without null, non-numeric values."""
    value = F.col("value")
    return counts.groupBy(*by, "column_name").agg(
        F.sum("n").alias("_rows"),
        F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count(F.lit(1)).alias("unique_count_including_null"),
        F.count(value).alias("unique_count_non_null"),
        F.count_if(value.isNotNull() & F.trim(value).try_cast("double").isNull()).alias("_not_numbers"),
    )


def inspect(df: DataFrame) -> DataFrame:
    """Structure of every column: type, distinct values, nulls, and what looks wrong with it.

    A typed column cannot mix types; ``is_mixed_type`` marks text columns that hold both numbers and
    other text. Null percent is rounded to two digits before the fully-null test.
    """
    numeric, text = numeric_columns(df), string_columns(df)
    folded = _folded(value_counts(df, df.columns), [])
    n_unique = F.col("unique_count_including_null")
    non_null = F.col("unique_count_non_null")
    name = F.col("column_name")
    is_text = name.isin(text) if text else F.lit(False)
    null_percent = _percent_null(F.col("null_count"), F.col("_rows"))
    return (
        folded.join(column_types(df), "column_name")
        .select(
            "column_name",
            "dtype",
            n_unique.alias("n_unique"),
            "null_count",
            null_percent.alias("null_percent"),
            (name.isin(numeric) if numeric else F.lit(False)).alias("is_numeric"),
            is_text.alias("is_object"),
            (is_text & (F.col("_not_numbers") > 0) & (F.col("_not_numbers") < non_null)).alias("is_mixed_type"),
            (is_text & (non_null > 0) & (F.col("_not_numbers") == 0)).alias("is_numeric_object"),
            (null_percent == 100).alias("is_fully_null"),
            ((n_unique <= 1) & (null_percent != 100)).alias("is_constant"),
        )
        .orderBy(F.desc("null_percent"), "column_name")
    )


def audit_strings(df: DataFrame, sample_size: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Text columns: distinct counts, null percent and sample values, most distinct first."""
    if sample_size <= 0:
        raise ValueError("sample_size must be positive")
    columns = [c for c in string_columns(df) if c not in by]
    keys = [*by, "column_name"]
    counts = value_counts(df, columns, by)
    samples = smallest_values(counts, sample_size, by)
    return (
        _folded(counts, by)
        .join(samples, keys, "left")
        .select(
            *keys,
            F.lit("string").alias("dtype"),
            "unique_count_including_null",
            "unique_count_non_null",
            _percent_null(F.col("null_count"), F.col("_rows")).alias("null_percent"),
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        )
        .orderBy(F.desc("unique_count_non_null"), F.desc("null_percent"), *keys)
    )


def plain_statistics(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, non_null, mean, std, min, max, skewness) from one grouped pass."""
    aggs, records = [], []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.skewness(v).alias(f"skew{i}"),
        ]
        records.append(
            record(
                column_name=c,
                non_null=F.col(f"n{i}"),
                mean=F.col(f"mean{i}"),
                std=F.when(F.col(f"n{i}") > 1, F.col(f"std{i}")),
                min=F.col(f"min{i}"),
                max=F.col(f"max{i}"),
                population_skewness=F.nanvl(F.col(f"skew{i}"), F.lit(None).cast("double")),
            )
        )
    return rows_of(df.groupBy(*by).agg(*aggs), list(by), records)


def medians_of(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "column_name"]
    numbers = counts.filter(F.col("number").isNotNull())
    return ordered.quantiles_of_counts(numbers, keys, "number", [0.5]).select(*keys, F.col("quantile").alias("median"))


def audit_numbers(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Numeric columns: distinct counts, null percent, mean, median, sample std, min, max."""
    columns = [c for c in numeric_columns(df) if c not in by]
    keys = [*by, "column_name"]
    # Written once: distinct counts, statistics and medians read both many times, and the plan below ``df`` may be long.
    df = written_once(df.select(*by, *columns), "audit-numbers")
    counts = written_once(value_counts(df, columns, by), "audit-counts")
    types = column_types(df, columns).select("column_name", "dtype")
    return (
        _folded(counts, by)
        .join(types, "column_name")
        .join(plain_statistics(df, columns, by), keys)
        .join(medians_of(counts, by), keys, "left")
        .select(
            *keys,
            "dtype",
            "unique_count_including_null",
            "unique_count_non_null",
            _percent_null(F.col("null_count"), F.col("_rows")).alias("null_percent"),
            "mean",
            "median",
            "std",
            "min",
            "max",
        )
        .orderBy(F.desc("null_percent"), *keys)
    )


def residual_text(df: DataFrame, split_name: str, sample_size: int = 5) -> DataFrame:
    """Text columns left after cleaning, flagged when a sample still looks like a number."""
    columns = string_columns(df)
    counts = value_counts(df, columns)
    rank = F.row_number().over(W.partitionBy("column_name").orderBy("value"))
    samples = (
        counts.filter(F.col("value").isNotNull())
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= sample_size)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list("value")).alias("_samples"))
    )

    def suspicious(x):
        bare = F.regexp_replace(x, r"^([^.]*)\.", "$1")
        bare = F.regexp_replace(bare, r"^([^-]*)-", "$1")
        return x.rlike("[%$,]") | F.replace(bare, F.lit("%"), F.lit("")).rlike(r"^\d+$")

    return (
        _folded(counts, [])
        .join(samples, "column_name", "left")
        .select(
            F.lit(split_name).alias("dataset_split"),
            "column_name",
            F.lit("string").alias("dtype"),
            F.col("null_count").alias("missing_count"),
            _percent_null(F.col("null_count"), F.col("_rows")).alias("missing_rate_percent"),
            F.col("unique_count_including_null").alias("unique_count_including_missing"),
            F.coalesce(F.array_join("_samples", " | "), F.lit("no non-missing values")).alias("sample_values"),
            F.coalesce(F.exists("_samples", suspicious), F.lit(False)).alias("suspicious_numeric_like_text"),
        )
        .orderBy(F.desc("suspicious_numeric_like_text"), "column_name")
    )


# --- small summaries ------------------------------------------------------------------------


def dataset_overview(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows and columns per split."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(label).alias("dataset_split"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
        )
        for label, df in (("train", train), ("test", test))
    ]
    return parts[0].unionByName(parts[1])


def split_table(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Two tables stacked with their label, train first, then by ``key``."""
    both = train.withColumn("dataset_split", F.lit("train")).unionByName(
        test.withColumn("dataset_split", F.lit("test")), allowMissingColumns=True
    )
    return both.orderBy(split_rank("dataset_split"), key)


def numeric_summary(df: DataFrame, feature: str, split: str = "split") -> DataFrame:
    """Count, missing percent, mean, median, p05 and p95 of one feature per split, two digits."""
    require_columns(df, feature, split)
    names = {0.05: "p05", 0.5: "median", 0.95: "p95"}
    quantiles = ordered.exact_quantile_columns(df, [split], feature, names)
    return (
        df.groupBy(split)
        .agg(
            F.count(feature).alias("count"),
            F.round(F.avg(F.col(feature).isNull().cast("double")) * 100, 2).alias("missing_percent"),
            F.round(F.avg(feature), 2).alias("mean"),
        )
        .join(F.broadcast(quantiles), split, "left")
        .select(
            F.lit(feature).alias("feature_name"),
            F.col(split).alias("dataset_split"),
            "count",
            "missing_percent",
            "mean",
            *[F.round(c, 2).alias(c) for c in ("median", "p05", "p95")],
        )
        .orderBy(split_rank("dataset_split"))
    )


def group_means(df: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    require_columns(df, group, *values)
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(*[F.round(F.avg(v), 2).alias(v) for v in values])


def skewness_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness, min, median, mean and max per feature, most skewed first.

    Constant features have no skewness (0, as the corrected moment of a constant), nor have
    features with fewer than three values (null).
    """
    require_columns(df, *features)
    n = F.col("non_null").cast("double")
    corrected = F.when(
        n >= 3,
        F.when(F.col("min") == F.col("max"), F.lit(0.0)).otherwise(
            F.col("population_skewness") * F.sqrt(n * (n - 1)) / (n - 2)
        ),
    )
    counts = value_counts(df, features)
    return (
        plain_statistics(df, features)
        .join(medians_of(counts, []), "column_name", "left")
        .select(
            F.col("column_name").alias("feature_name"),
            F.col("non_null").alias("non_null_count"),
            corrected.alias("skewness"),
            F.col("min").alias("min_value"),
            F.col("median").alias("median_value"),
            F.col("mean").alias("mean_value"),
            F.col("max").alias("max_value"),
        )
        .orderBy(F.desc_nulls_last("skewness"), "feature_name")
    )


def year_range(df: DataFrame, year: str = "issue_year", split: str = "split") -> DataFrame:
    per_year = df.filter(F.col(year).isNotNull()).groupBy(split, year).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_year.groupBy(F.col(split).alias("dataset_split"))
        .agg(
            F.min(year).alias("min_issue_year"),
            F.max(year).alias("max_issue_year"),
            F.count(year).alias("distinct_issue_years"),
        )
        .orderBy(split_rank("dataset_split"))
    )


def status_by_split(df: DataFrame, status: str = "loan_status", split: str = "split") -> DataFrame:
    """Status counts per split, null as a status, absent ones 0. A split other than train or test fails the job."""
    return (
        df.select(status, ensure(F.col(split).isin(*SPLITS), F.col(split), "split must be train or test").alias(split))
        .groupBy(status)
        .agg(
            F.count_if(F.col(split) == "train").alias("train_count"),
            F.count_if(F.col(split) == "test").alias("test_count"),
        )
        .orderBy(F.desc("train_count"), status)
    )


def status_shares(df: DataFrame, status: str = "loan_status", by: Sequence[str] = ()) -> DataFrame:
    """Counts per label and status (null included) with their percent of all rows of the label.

    Statuses are gathered as one small map a label, so the totals come from the same aggregation.
    """
    counts = df.groupBy(*by, status).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*by).agg(F.sum("count").alias("_all"), F.collect_list(F.struct(status, "count")).alias("_each"))
    each = totals.select(*by, "_all", F.inline("_each"))
    share = F.round(F.col("count") / F.col("_all") * 100, 2).alias("percentage")
    return each.select(*by, status, "count", share).orderBy(*by, F.desc("count"), status)
