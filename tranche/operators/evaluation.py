"""Scores against outcomes: ROC and AUC, classification metrics, outcome exposure, calibration."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche.functions.guards import binary_target, ensure, not_null, require_columns
from tranche.functions.shape import record, rows_of
from tranche.operators import ordered
from tranche.operators.cohort import split_rank

LABELS = ["model_name", "dataset_name"]
SYSTEM_LABELS = ["system_name", "dataset_name"]
# Outcome names in report order.
OUTCOME_TYPES = ["true_positive", "true_negative", "false_positive", "false_negative"]


# --- ranking by subgrade --------------------------------------------------------------------


def subgrade_rank(column: Column) -> Column:
    """a1..g5 -> 1..35; any other text or null fails the job."""
    grade, step = F.substring(column, 1, 1), F.substring(column, 2, 1)
    valid = (F.length(column) == 2) & grade.between("a", "g") & step.between("1", "5")
    rank = (F.ascii(column) - F.ascii(F.lit("a"))) * 5 + F.ascii(step) - F.ascii(F.lit("0"))
    return ensure(valid, rank, F.concat(F.lit("unknown subgrade: "), column))


def with_subgrade_rank(df: DataFrame, subgrade: str = "sub_grade", output: str = "subgrade_rank") -> DataFrame:
    require_columns(df, subgrade)
    return df.withColumn(output, subgrade_rank(F.col(subgrade)))


# --- ROC ------------------------------------------------------------------------------------


def _class_totals(df: DataFrame, by: Sequence[str], target: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: the only shuffle of the raw rows."""
    require_columns(df, target, score, *by)
    y = binary_target(target)
    return (
        df.select(*by, not_null(score).alias("threshold"), y.alias("_y"))
        .groupBy(*by, "threshold")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    )


def _both_classes(value: Column) -> Column:
    return ensure((F.col("all_pos") > 0) & (F.col("all_neg") > 0), value, "ROC needs both classes in every group")


def _auc(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trapezoid area: every negative counts the positives above it, ties count half."""
    won = F.col("neg").cast("double") * (F.col("before_pos") + F.col("pos") / F.lit(2.0))
    totals = curve.groupBy(*by).agg(
        F.sum(won).alias("won"), F.max("all_pos").alias("all_pos"), F.max("all_neg").alias("all_neg")
    )
    return totals.select(
        *by, _both_classes(F.col("won") / F.col("all_pos") / F.col("all_neg")).alias("auc")
    )


def auc(df: DataFrame, by: Sequence[str], target: str, score: str) -> DataFrame:
    """(by, auc). One value per group; a group with a single class fails the job."""
    totals = _class_totals(df, by, target, score)
    return _auc(ordered.running_totals(totals, by, "threshold", ["pos", "neg"], descending=True), by)


def roc_points(
    df: DataFrame,
    target: str = "target_default",
    score: str = "predicted_default_probability",
    by: Sequence[str] = tuple(SYSTEM_LABELS),
    drop_collinear: bool = True,
) -> DataFrame:
    """ROC points per group, from (0, 0) at an infinite threshold, with the group's AUC on each row.

    A point between two equal steps carries no shape and is dropped; first and last stay.
    """
    by = list(by)
    totals = _class_totals(df, by, target, score)
    curve = ordered.running_totals(totals, by, "threshold", ["pos", "neg"], descending=True, with_next=True)
    areas = _auc(curve, by)
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    points = curve
    if drop_collinear:
        is_end = F.col("next_pos").isNull() | ((F.col("before_pos") == 0) & (F.col("before_neg") == 0))
        bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        points = points.filter(is_end | bends)
    points = points.select(
        *by,
        (fp / F.col("all_neg")).alias("false_positive_rate"),
        (tp / F.col("all_pos")).alias("true_positive_rate"),
        F.col("threshold").cast("double").alias("threshold"),
    )
    origin = areas.select(
        *by,
        F.lit(0.0).alias("false_positive_rate"),
        F.lit(0.0).alias("true_positive_rate"),
        F.lit(float("inf")).alias("threshold"),
    )
    # One row per group: bounded by the number of labels.
    return points.unionByName(origin).join(F.broadcast(areas), by)


def label_system(df: DataFrame, system_name: str, split: str = "split") -> DataFrame:
    """Add the system and dataset names that curves and tables are keyed by."""
    return df.withColumns({"system_name": F.lit(system_name), "dataset_name": F.col(split)})


def model_roc(
    df: DataFrame, system_name: str = "model", target: str = "target_default",
    score: str = "predicted_default_probability", split: str = "split",
) -> DataFrame:
    return roc_points(label_system(df, system_name, split), target, score)


def subgrade_roc(
    df: DataFrame, system_name: str = "baseline_subgrade", target: str = "target_default",
    subgrade: str = "sub_grade", split: str = "split",
) -> DataFrame:
    """ROC of the subgrade rank used as a risk score: at most 35 points."""
    ranked = with_subgrade_rank(df, subgrade, "_rank")
    return roc_points(label_system(ranked, system_name, split), target, "_rank")


# --- scoring and metrics --------------------------------------------------------------------


def with_predictions(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """``predicted_probability`` and ``predicted_label`` (1 when p >= threshold)."""
    if not 0.0 <= float(threshold) <= 1.0:
        raise ValueError("threshold must lie in [0, 1]")
    p = not_null(score)
    return df.withColumns(
        {"predicted_probability": p, "predicted_label": (p >= F.lit(float(threshold))).cast("bigint")}
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def classification_metrics(df: DataFrame, target: str = "target_default", by: Sequence[str] = tuple(LABELS)) -> DataFrame:
    """AUC, accuracy, precision, recall, F1, Brier score and the confusion cells per group."""
    by = list(by)
    require_columns(df, target, "predicted_label", "predicted_probability", *by)
    y, label = F.col("_y"), F.col("predicted_label")
    cells = (
        df.withColumn("_y", binary_target(target))
        .groupBy(*by)
        .agg(
            F.avg(F.pow(F.col("predicted_probability") - y, 2)).alias("brier_score"),
            F.count_if((y == 0) & (label == 0)).alias("true_negative"),
            F.count_if((y == 0) & (label == 1)).alias("false_positive"),
            F.count_if((y == 1) & (label == 0)).alias("false_negative"),
            F.count_if((y == 1) & (label == 1)).alias("true_positive"),
        )
    )
    tn, fp = F.col("true_negative"), F.col("false_positive")
    fn, tp = F.col("false_negative"), F.col("true_positive")
    # One row per label on both sides.
    return cells.join(F.broadcast(auc(df, by, target, "predicted_probability")), by).select(
        *by,
        F.col("auc").alias("roc_auc"),
        ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        "brier_score",
        "true_negative",
        "false_positive",
        "false_negative",
        "true_positive",
    )


def combine(tables: Sequence[DataFrame]) -> DataFrame:
    if not tables:
        raise ValueError("no tables to combine")
    return reduce(DataFrame.unionByName, tables)


def outcome_type(target: Column, label: Column) -> Column:
    name = (
        F.when((target == 1) & (label == 1), "true_positive")
        .when((target == 0) & (label == 0), "true_negative")
        .when((target == 0) & (label == 1), "false_positive")
        .when((target == 1) & (label == 0), "false_negative")
    )
    return ensure(name.isNotNull(), name, "row with neither outcome: target and label must be 0 or 1")


def row_outcomes(
    df: DataFrame, target: str = "target_default", amount: str = "loan_amnt",
    keep: Sequence[str] = (), threshold: float | None = None,
) -> DataFrame:
    """Outcome name per scored row, with its amount."""
    require_columns(df, target, "predicted_label", "predicted_probability", amount, *LABELS)
    columns = [
        *keep,
        F.col(target).alias("actual_label"),
        "predicted_label",
        "predicted_probability",
        amount,
        *LABELS,
        outcome_type(F.col(target), F.col("predicted_label")).alias("outcome_type"),
    ]
    if threshold is not None:
        columns.append(F.lit(float(threshold)).alias("threshold"))
    return df.select(*columns)


def outcome_summary(outcomes: DataFrame, amount: str = "loan_amnt") -> DataFrame:
    """Count, total, mean and exact median amount per model, dataset and outcome."""
    by = [*LABELS, "outcome_type"]
    require_columns(outcomes, amount, *by)
    medians = ordered.exact_quantiles(outcomes, by, amount, [0.5]).select(
        *by, F.col("quantile").alias("median_loan_amnt")
    )
    return (
        outcomes.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum(amount).alias("total_loan_amnt"),
            F.avg(amount).alias("average_loan_amnt"),
        )
        .join(F.broadcast(medians), by, "left")
    )


# --- calibration and risk bands -------------------------------------------------------------


def calibration_table(
    df: DataFrame,
    target: str = "target_default",
    score: str = "predicted_default_probability",
    by: Sequence[str] = tuple(SYSTEM_LABELS),
    bins: int = 10,
    merge_equal_edges: bool = True,
) -> DataFrame:
    """Mean score against observed rate in equal-count score bins; empty bins are left out."""
    by = list(by)
    require_columns(df, target, score, *by)
    scored = df.select(*by, not_null(score).alias("_p"), binary_target(target).alias("_y"))
    edges = ordered.bin_edges(scored, by, "_p", bins, merge_equal_edges)
    table = (
        ordered.with_bin(scored, edges, by, "_p", bins)
        .groupBy(*by, "bin")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.avg("_p").alias("predicted_probability_mean"),
            F.avg("_y").alias("observed_default_rate"),
            F.min("_p").alias("predicted_probability_min"),
            F.max("_p").alias("predicted_probability_max"),
        )
    )
    return _numbered(table, edges, by, "bin_order", "calibration_bin").select(
        *by,
        "bin_order",
        "calibration_bin",
        "bin_low",
        "bin_high",
        "row_count",
        "predicted_probability_mean",
        "observed_default_rate",
        "predicted_probability_min",
        "predicted_probability_max",
    )


def _numbered(table: DataFrame, edges: DataFrame, by: Sequence[str], order: str, label: str) -> DataFrame:
    """Number the filled bins 1..k within the group and add their limits (at most ``bins`` rows each)."""
    from pyspark.sql.window import Window as W

    limits = ordered.bin_spine(edges, by)
    place = F.row_number().over(W.partitionBy(*by).orderBy("bin")).cast("bigint")
    return (
        table.join(F.broadcast(limits), [*by, "bin"])
        .withColumn(order, place)
        .withColumn(label, ordered.bin_label())
        .orderBy(*[split_rank(c) if c == "dataset_name" else F.col(c) for c in by], order)
    )


def risk_bands(
    df: DataFrame,
    score: str = "predicted_default_probability",
    target: str = "target_default",
    dataset: str = "dataset_name",
    bands: int = 10,
    interest_rate: str | None = None,
) -> DataFrame:
    """Loans in equal-count score bands: size, mean score, observed rate, optionally pricing.

    Interest rates given in percent (largest value of the dataset above 1) are shown as shares. A null score, a
    target other than 0 or 1, and a dataset without any interest rate fail the job.
    """
    require_columns(df, score, target, dataset, *([interest_rate] if interest_rate else []))
    base = df.select(
        dataset, not_null(score).alias("_p"), binary_target(target).alias("_y"), *([interest_rate] if interest_rate else [])
    )
    edges = ordered.bin_edges(base, [dataset], "_p", bands)
    banded = ordered.with_bin(base, edges, [dataset], "_p", bands)
    aggs = [
        F.count(F.lit(1)).alias("loan_count"),
        F.avg("_p").alias("predicted_default_probability_mean"),
        F.avg("_y").alias("observed_default_rate"),
    ]
    if interest_rate:
        aggs += [F.avg(interest_rate).alias("_mean"), F.max(interest_rate).alias("_top")]
    table = banded.filter(F.col("bin").isNotNull()).groupBy(dataset, "bin").agg(*aggs)
    if interest_rate:
        from pyspark.sql.window import Window as W

        medians = ordered.exact_quantiles(banded.filter(F.col("bin").isNotNull()), [dataset, "bin"], interest_rate, [0.5])
        # The top rate per band is already aggregated: this window sees at most ``bands`` rows.
        top = F.max("_top").over(W.partitionBy(dataset))
        scale = F.when(ensure(top.isNotNull(), top, "interest rates are all missing") > 1.0, 100.0).otherwise(1.0)
        table = (
            table.join(F.broadcast(medians), [dataset, "bin"], "left")
            .withColumn("_scale", scale)
            .withColumns(
                {"int_rate_mean": F.col("_mean") / F.col("_scale"), "int_rate_median": F.col("quantile") / F.col("_scale")}
            )
            .drop("_mean", "_top", "_scale", "quantile", "probability")
        )
    numbered = _numbered(table, edges, [dataset], "band_order", "risk_band")
    return numbered.select(
        dataset,
        "band_order",
        "risk_band",
        "bin_low",
        "bin_high",
        "loan_count",
        "predicted_default_probability_mean",
        "observed_default_rate",
        *(["int_rate_mean", "int_rate_median"] if interest_rate else []),
    )


def selection_record(metrics: DataFrame, outcomes: DataFrame, model_name: str, dataset_name: str = "test") -> DataFrame:
    """One row for the chosen model: its metrics and the amounts lost to either error."""
    here = (F.col("model_name") == model_name) & (F.col("dataset_name") == dataset_name)
    exposure = (
        outcomes.filter(here)
        .groupBy(*LABELS)
        .agg(
            F.sum(F.when(F.col("outcome_type") == "false_negative", F.col("total_loan_amnt"))).alias("false_negative_exposure"),
            F.sum(F.when(F.col("outcome_type") == "false_positive", F.col("total_loan_amnt"))).alias("false_positive_exposure"),
        )
    )
    return metrics.filter(here).join(exposure, LABELS)


def confusion_matrix(df: DataFrame, target: str = "target_default", label: str = "predicted_label") -> DataFrame:
    """Four rows (actual, predicted, count), zero cells included."""
    y, p = F.col(target), F.col(label)
    names = [(a, b) for a in (0, 1) for b in (0, 1)]
    counts = df.agg(*[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a, b in names])
    return rows_of(
        counts, [], [record(actual_label=F.lit(a).cast("bigint"), predicted_label=F.lit(b).cast("bigint"), loan_count=F.col(f"c{a}{b}")) for a, b in names]
    )
