"""Validation tables: alignment of clean and scored rows, grade structure, subgrade rates, AUC tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche import contracts
from tranche.functions.guards import binary_target, ensure, not_null, require_columns
from tranche.functions.text import lookup
from tranche.operators import ordered
from tranche.operators.cohort import POSITIVE_STATUSES, TERMINAL_STATUSES, split_rank
from tranche.operators.evaluation import combine, subgrade_rank

SUBGRADES = [f"{g}{n}" for g in "abcdefg" for n in range(1, 6)]


def align_clean_rows(
    clean: DataFrame, modeled: DataFrame, key: Sequence[str] = ("split", "row_id"), target: str = "target_default",
    enforced: bool = True,
) -> DataFrame:
    """The clean rows of the modeled loans, with the target derived from the status where absent.

    Keys must be unique on both sides and every modeled key must be clean; otherwise the call fails.
    """
    require_columns(clean, *key)
    require_columns(modeled, *key)
    if enforced:
        contracts.enforce(
            contracts.all_of(contracts.unique_key(clean, *key), contracts.unique_key(modeled, *key), missing_keys(modeled, clean, *key))
        )
    kept = clean.join(modeled.select(*key), list(key), "left_semi")
    if target not in kept.columns:
        require_columns(kept, "loan_status")
        codes = {s: int(s in POSITIVE_STATUSES) for s in TERMINAL_STATUSES}
        status = not_null("loan_status")
        kept = kept.withColumn(target, lookup(status, codes, what="loan status").cast("bigint"))
    return kept.withColumn(target, ensure(F.col(target).isNotNull(), F.col(target), f"{target} must not be null"))


def missing_keys(wanted: DataFrame, present: DataFrame, *key: str) -> DataFrame:
    """(contract, violations): keys of ``wanted`` that ``present`` lacks."""
    both = contracts.same_keys(wanted, present, *key)
    return both.filter(F.col("contract") == "keys_missing_on_right")


def alignment_contracts(clean_rows: DataFrame, modeled: DataFrame, key: Sequence[str] = ("split", "row_id")) -> DataFrame:
    """Unique keys on both sides and no key missing from either: (contract, violations)."""
    return contracts.all_of(
        contracts.unique_key(clean_rows, *key),
        contracts.unique_key(modeled, *key),
        contracts.same_keys(modeled, clean_rows, *key),
    )


def validation_dataset(
    modeled: DataFrame, clean_rows: DataFrame, model, key: Sequence[str] = ("split", "row_id"),
    score: str = "predicted_default_probability",
) -> DataFrame:
    """Score the modeled rows and attach the probability to their clean rows, one to one; anything else fails."""
    from pyspark.ml.functions import vector_to_array

    contracts.enforce(alignment_contracts(clean_rows, modeled, key))
    scored = model.transform(modeled).select(*key, vector_to_array("probability")[1].alias(score))
    return clean_rows.join(scored, list(key))


def grade_structure(df: DataFrame, grade: str = "grade", subgrade: str = "sub_grade", split: str = "split") -> DataFrame:
    """Loans, distinct subgrades and missing subgrades per grade; null grades are left out."""
    require_columns(df, grade, subgrade, split)
    per_pair = (
        df.filter(F.col(grade).isNotNull())
        .groupBy(split, grade, subgrade)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_pair.groupBy(split, grade)
        .agg(
            F.sum("n").alias("loan_count"),
            F.count(subgrade).alias("distinct_subgrades"),
            F.coalesce(F.sum(F.when(F.col(subgrade).isNull(), F.col("n"))), F.lit(0)).alias("missing_subgrade_count"),
        )
        .withColumn("missing_subgrade_rate", F.col("missing_subgrade_count") / F.col("loan_count"))
        .orderBy(split_rank(split), grade)
    )


def subgrade_distribution(
    df: DataFrame, grade: str = "grade", subgrade: str = "sub_grade", split: str = "split"
) -> DataFrame:
    require_columns(df, grade, subgrade, split)
    return (
        df.filter(F.col(grade).isNotNull() & F.col(subgrade).isNotNull())
        .groupBy(split, grade, subgrade)
        .agg(F.count(F.lit(1)).alias("loan_count"))
        .orderBy(split_rank(split), grade, subgrade)
    )


def default_rate_by_subgrade(
    df: DataFrame, target: str = "target_default", subgrade: str = "sub_grade", split: str = "split"
) -> DataFrame:
    require_columns(df, target, subgrade, split)
    return (
        df.select(split, not_null(subgrade).alias(subgrade), binary_target(target).alias(target))
        .groupBy(split, subgrade)
        .agg(F.count(F.lit(1)).alias("loan_count"), F.sum(target).alias("default_count"))
        .withColumn("non_default_count", F.col("loan_count") - F.col("default_count"))
        .withColumn("default_rate", F.col("default_count") / F.col("loan_count"))
    )


def subgrade_pivot(
    distribution: DataFrame, split: str = "split", grade: str = "grade", subgrade: str = "sub_grade",
    count: str = "loan_count", subgrades: Sequence[str] = tuple(SUBGRADES),
) -> DataFrame:
    """Rows (split, grade), a zero-filled count column per subgrade; repeated keys and unlisted subgrades fail the job.

    Rows come in plain text order of the split (test before train), as the reference table does.
    """
    require_columns(distribution, split, grade, subgrade, count)
    known = ensure(F.col(subgrade).isin(*subgrades), F.col(subgrade), F.concat(F.lit("unknown subgrade: "), F.coalesce(subgrade, F.lit("null"))))
    checked = distribution.withColumn(subgrade, known).groupBy(split, grade, subgrade).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(count).alias("_c")
    )
    single = checked.withColumn("_c", ensure(F.col("_n") == 1, F.col("_c"), "repeated split, grade and subgrade"))
    return (
        single.groupBy(split, grade)
        .pivot(subgrade, list(subgrades))
        .agg(F.sum("_c"))
        .na.fill(0)
        .orderBy(split, grade)
    )


def normalised_pivot(pivoted: DataFrame, split: str = "split", grade: str = "grade") -> DataFrame:
    """Each count as a share of its row; an empty row fails the job."""
    columns = [c for c in pivoted.columns if c not in (split, grade)]
    if not columns:
        raise ValueError("no count columns")
    total = sum((F.col(c) for c in columns), F.lit(0))
    safe = ensure(total != 0, total, "row without any loans")
    return pivoted.select(split, grade, *[(F.col(c) / safe).alias(c) for c in columns]).orderBy(split_rank(split), grade)


def ordered_subgrades(rates: DataFrame, split: str = "split", subgrade: str = "sub_grade") -> DataFrame:
    """Split order, then a1..g5; repeated (split, subgrade) rows fail the job.

    Works on the rate table, which has at most 35 rows per split.
    """
    from pyspark.sql.window import Window as W

    repeats = F.count(F.lit(1)).over(W.partitionBy(split, subgrade))
    return (
        rates.withColumn("_repeats", repeats)
        .withColumn(subgrade, ensure(F.col("_repeats") == 1, F.col(subgrade), "repeated split and subgrade"))
        .drop("_repeats")
        .orderBy(split_rank(split), subgrade_rank(F.col(subgrade)))
    )


def risk_separation(roc: DataFrame, system: str = "system_name", dataset: str = "dataset_name") -> DataFrame:
    """One AUC per system and dataset; two different values for one pair fail the job."""
    require_columns(roc, system, dataset, "auc")
    return (
        roc.groupBy(system, dataset)
        .agg(F.min("auc").alias("auc"), F.max("auc").alias("_top"))
        .select(system, dataset, ensure(F.col("auc") == F.col("_top"), F.col("auc"), "several AUC values for one system").alias("auc"))
        .orderBy(split_rank(dataset), system)
    )


def roc_artifact(*curves: DataFrame) -> DataFrame:
    wanted = ["system_name", "dataset_name", "false_positive_rate", "true_positive_rate", "threshold", "auc"]
    for c in curves:
        require_columns(c, *wanted)
    return combine([c.select(*wanted) for c in curves]).orderBy(
        split_rank("dataset_name"), "system_name", "false_positive_rate", "true_positive_rate"
    )


def calibration_artifact(*tables: DataFrame) -> DataFrame:
    return combine(list(tables)).orderBy(split_rank("dataset_name"), "system_name", "bin_order")


def stack_splits(train: DataFrame, test: DataFrame, split: str = "split") -> DataFrame:
    """Label two tables with their split and put train first."""
    return train.withColumn(split, F.lit("train")).unionByName(test.withColumn(split, F.lit("test"))).orderBy(split_rank(split))


def describe_rates(rates: DataFrame, split: str = "split", rate: str = "default_rate") -> DataFrame:
    """count, mean, std, min, quartiles and max of the rates per split."""
    require_columns(rates, split, rate)
    names = {0.25: "p25", 0.5: "p50", 0.75: "p75"}
    quartiles = ordered.exact_quantile_columns(rates, [split], rate, names)
    return (
        rates.groupBy(split)
        .agg(
            F.count(rate).alias("count"),
            F.avg(rate).alias("mean"),
            F.stddev_samp(rate).alias("std"),
            F.min(rate).alias("min"),
            F.max(rate).alias("max"),
        )
        .join(F.broadcast(quartiles), split, "left")
        .select(split, "count", "mean", "std", "min", "p25", "p50", "p75", "max")
        .orderBy(split_rank(split))
    )


def auc_comparison(model_roc: DataFrame, baseline_roc: DataFrame) -> DataFrame:
    """Model and baseline AUC per split, in fixed order."""
    both = combine([risk_separation(model_roc), risk_separation(baseline_roc)])
    return both.select(
        F.col("system_name").alias("system"), F.col("dataset_name").alias("split"), "auc"
    ).orderBy(split_rank("split"), split_rank("system", ["model", "baseline_subgrade"]))
