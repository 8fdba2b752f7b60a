"""The tables behind the report's figures (drawing is left to the caller)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche import contracts
from tranche.functions.guards import ensure, require_columns
from tranche.functions.shape import record
from tranche.operators import evaluation
from tranche.operators.cohort import SPLITS, split_rank

# The grades, of which each has five subgrades.
GRADES = tuple("abcdefg")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 40) -> DataFrame:
    """(column_name, bin, bin_low, bin_high, count): equal-width bins from min to max, the last one closed.

    A column with a single value gets the usual half-unit margin on both sides. Two passes: limits,
    then counts; bins without rows are kept.
    """
    require_columns(df, *columns)
    if bins < 1:
        raise ValueError("bins must be positive")
    long = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot([], list(columns), "column_name", "value")
        .filter(F.col("value").isNotNull())
    )
    low, high = F.min("value"), F.max("value")
    limits = long.groupBy("column_name").agg(
        F.when(low == high, low - 0.5).otherwise(low).alias("low"),
        F.when(low == high, high + 0.5).otherwise(high).alias("high"),
    )
    share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
    place = F.least(F.floor(share * bins), F.lit(bins - 1).cast("bigint")) + 1
    # One row per column name.
    counted = long.join(F.broadcast(limits), "column_name").groupBy("column_name", place.alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    width = (F.col("high") - F.col("low")) / bins
    spine = limits.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
    return (
        spine.join(counted, ["column_name", "bin"], "left")
        .select(
            "column_name",
            "bin",
            (F.col("low") + width * (F.col("bin") - 1)).alias("bin_low"),
            (F.col("low") + width * F.col("bin")).alias("bin_high"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("column_name", "bin")
    )


def log_histograms(df: DataFrame, columns: Sequence[str], bins: int = 40) -> DataFrame:
    """Histograms of the raw and the log1p values, named ``<c>`` and ``log1p_<c>``; negatives fail the job."""
    both: dict[str, Column] = {}
    for c in columns:
        v = F.col(c).cast("double")
        v = F.when(v.isNotNull(), ensure(v >= 0, v, f"negative value in {c}"))
        both[c] = v
        both[f"log1p_{c}"] = F.log1p(v)
    return histogram(df.select(*[e.alias(n) for n, e in both.items()]), list(both), bins)


def calibration_curve(df: DataFrame, target: str, score: str, by: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean score and observed rate per quantile bin; equal edges are kept, empty bins left out."""
    table = evaluation.calibration_table(df, target, score, by, bins, merge_equal_edges=False)
    return table.select(*by, "bin_order", "predicted_probability_mean", "observed_default_rate")


def outcome_by_model(summary: DataFrame, models: Sequence[str], dataset: str = "test", value: str = "total_loan_amnt") -> DataFrame:
    """Rows in fixed outcome order, one value column per model."""
    require_columns(summary, "model_name", "dataset_name", "outcome_type", value)
    rank = split_rank("outcome_type", evaluation.OUTCOME_TYPES)
    return (
        summary.filter((F.col("dataset_name") == dataset) & F.col("model_name").isin(list(models)))
        .groupBy("outcome_type")
        .pivot("model_name", list(models))
        .agg(F.max(value))
        .orderBy(rank)
    )


def portfolio_series(volume: DataFrame, rate: DataFrame, year: str = "issue_year") -> DataFrame:
    """Volume and default rate per split and year."""
    return (
        volume.select("dataset_split", year, F.col("loan_count").alias("issued_count"))
        .join(rate.select("dataset_split", year, "default_rate_percent"), ["dataset_split", year], "left")
        .orderBy(split_rank("dataset_split"), year)
    )


def band_labels(bands: DataFrame) -> DataFrame:
    """``(a, b]`` risk bands as ``a%–b%``, lowest risk first."""
    low = F.regexp_extract("risk_band", r"\(([^,]+),", 1).cast("double")
    high = F.regexp_extract("risk_band", r",\s*([^\]]+)\]", 1).cast("double")
    return bands.withColumn("risk_band_label", F.format_string("%.0f%%–%.0f%%", low * 100, high * 100)).orderBy(
        *[c for c in ("dataset_name",) if c in bands.columns], "predicted_default_probability_mean"
    )


def policy_frontier(model: DataFrame, baseline: DataFrame, dataset: str = "test") -> DataFrame:
    """Acceptance rate against default rate of both systems, in order of acceptance."""
    sides = [
        df.filter(F.col("dataset_name") == dataset).select(
            F.lit(name).alias("system_name"),
            F.col("policy_value").cast("string").alias("policy_value"),
            "acceptance_rate",
            "default_rate_among_accepted",
        )
        for name, df in (("model", model), ("baseline", baseline))
    ]
    return sides[0].unionByName(sides[1]).orderBy("system_name", "acceptance_rate")


def economic_difference(matched: DataFrame, value: str = "net_value_with_opportunity_cost_diff") -> DataFrame:
    require_columns(matched, "baseline_acceptance_rate", value)
    return matched.select("baseline_policy", "baseline_acceptance_rate", value).orderBy("baseline_acceptance_rate")


def grade_slices(normalised: DataFrame, split: str = "split", grade: str = "grade") -> DataFrame:
    """(split, grade, sub_grade, share): the five own subgrades of every grade.

    A split must have one row for each of the seven grades; otherwise the call fails.
    """
    counted = normalised.groupBy(split).agg(F.count(grade).alias("rows"), F.count_distinct(grade).alias("grades"))
    broken = counted.filter((F.col("rows") != len(GRADES)) | (F.col("grades") != len(GRADES)))
    contracts.enforce(broken.select(F.lit("one row per split and grade").alias("contract"), F.col(split), F.lit(1).alias("violations")))
    columns = [c for c in normalised.columns if c not in (split, grade)]
    long = normalised.unpivot([split, grade], columns, "sub_grade", "share")
    return long.filter(F.substring("sub_grade", 1, 1) == F.col(grade)).orderBy(split_rank(split), grade, "sub_grade")


def split_pivot(table: DataFrame, category: str, value: str, split: str = "dataset_split", splits: Sequence[str] = tuple(SPLITS)) -> DataFrame:
    """One row per category, one value column per split; a split outside the list fails the job."""
    table = table.withColumn(split, ensure(F.col(split).isin(*splits), F.col(split), "unlisted split"))
    return table.groupBy(category).pivot(split, list(splits)).agg(F.max(value)).orderBy(category)


def split_series(table: DataFrame, x: str, y: str, split: str = "dataset_split") -> DataFrame:
    return table.select(split, x, y).orderBy(split_rank(split), x)


def roc_slice(artifact: DataFrame, dataset: str = "test") -> DataFrame:
    return artifact.filter(F.col("dataset_name") == dataset).orderBy(
        "system_name", "false_positive_rate", "true_positive_rate"
    )


def calibration_slice(artifact: DataFrame, dataset: str = "test") -> DataFrame:
    return (
        artifact.filter(F.col("dataset_name") == dataset)
        .select("system_name", "bin_order", "predicted_probability_mean", "observed_default_rate")
        .orderBy("system_name", "predicted_probability_mean")
    )


def band_profile(bands: DataFrame, values: Sequence[str] = ("observed_default_rate",)) -> DataFrame:
    require_columns(bands, *values)
    keys = [c for c in ("dataset_name", "risk_band") if c in bands.columns]
    return bands.select(*keys, "predicted_default_probability_mean", *values).orderBy(
        *[c for c in ("dataset_name",) if c in bands.columns], "predicted_default_probability_mean"
    )
