"""Model features: log and one-hot columns, train-fitted imputation, branches, weights."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.contracts import ContractViolation
from tranche.functions.guards import ensure, require_columns
from tranche.functions.shape import record, rows_of
from tranche.operators import ordered, profile

WEIGHT_METHODS = ("sqrt", "log", "raw")


def _unique(features: Sequence[str]) -> list[str]:
    names = list(dict.fromkeys(features))
    if not names:
        raise ValueError("at least one feature is needed")
    return names


def log1p(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """log(1 + x) in place as double; a negative value fails the job, nulls stay."""
    names = _unique(features)
    require_columns(df, *names)

    def transformed(name: str):
        v = F.col(name).cast("double")
        return F.when(v.isNotNull(), ensure(v >= 0, F.log1p(v), f"negative value in {name}"))

    return df.withColumns({n: transformed(n) for n in names})


def category_table(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_name, position, category): sorted non-null train categories, numbered from 1."""
    names = _unique(features)
    require_columns(train, *names)
    long = (
        train.select(*[F.col(n).cast("string").alias(n) for n in names])
        .unpivot([], names, "feature_name", "category")
        .filter(F.col("category").isNotNull())
    )
    placed = ordered.dense_positions(long, ["feature_name"], "category", "position")
    return placed.select("feature_name", "position", "category")


def category_lists(train: DataFrame, features: Sequence[str], most: int | None = None) -> dict[str, list[str]]:
    """The category table as fitted state: {feature: sorted categories}, each to become a column.

    With ``most``, a feature of more categories is refused before any of them are collected.
    """
    names = _unique(features)
    require_columns(train, *names)
    long = train.select(*[F.col(n).cast("string").alias(n) for n in names]).unpivot(
        [], names, "feature_name", "category"
    )
    seen = long.filter(F.col("category").isNotNull()).distinct()
    if most is not None:
        sizes = {r.feature_name: r["count"] for r in seen.groupBy("feature_name").count().collect()}
        too_many = sorted(n for n, size in sizes.items() if size > most)
        if too_many:
            raise ContractViolation(f"too many categories for one-hot columns: {too_many}")
    lists: dict[str, list[str]] = {n: [] for n in names}
    for r in seen.collect():
        lists[r.feature_name].append(r.category)
    return {n: sorted(v) for n, v in lists.items()}


def one_hot(df: DataFrame, categories: dict[str, Sequence[str]]) -> DataFrame:
    """Replace each feature by boolean ``<feature>_<category>`` columns; unseen and null are all false."""
    require_columns(df, *categories)
    kept = [F.col(c) for c in df.columns if c not in categories]
    flags = [
        F.coalesce(F.col(f).cast("string") == F.lit(v), F.lit(False)).alias(f"{f}_{v}")
        for f, values in categories.items()
        for v in values
    ]
    return df.select(*kept, *flags)


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill nulls with the fitted medians (as double)."""
    require_columns(df, *medians)
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(float(m))) for n, m in medians.items()})


def _median_ends(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The one or two middle train values per feature, as fitted state."""
    if not features:
        return {}
    names = _unique(features)
    numbers = profile.value_counts(train, names).filter(F.col("number").isNotNull())
    ends = ordered.quantile_ends(numbers, ["column_name"], "number", [0.5])
    fitted = {row.column_name: (row.low, row.high) for row in ends.collect()}
    empty = [n for n in names if n not in fitted]
    if empty:
        raise ContractViolation(f"no train values to take a median from: {empty}")
    return fitted


def fit_medians(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Train medians as fitted state, one number per feature."""
    return {f: low + (high - low) / 2 for f, (low, high) in _median_ends(train, _unique(features)).items()}


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count) of every column in one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return rows_of(counts, [], [record(column_name=c, null_count=F.col(c)) for c in df.columns])


def features_to_impute(train: DataFrame) -> list[str]:
    """Columns with a null in the TRAIN split; nulls that only the test split has stay null."""
    return sorted(r.column_name for r in null_counts(train).filter("null_count > 0").collect())


@dataclass(frozen=True)
class FeatureRules:
    """What the branches do: which columns are logged, encoded, kept as flags or dropped."""

    log: Sequence[str]
    categorical: Sequence[str]
    binary: Sequence[str] = ()
    numeric: Sequence[str] = ()
    dropped: Sequence[str] = ()
    target: str = "target_default"
    keep: Sequence[str] = field(default=("row_id", "split"))


def coverage_contract(df: DataFrame, rules: FeatureRules) -> None:
    """Every column belongs to exactly the groups the rules name."""
    known = {*rules.dropped, *rules.categorical, *rules.binary, *rules.numeric, rules.target, *rules.keep}
    missing, extra = sorted(set(df.columns) - known), sorted(known - set(df.columns))
    if missing or extra:
        raise ContractViolation(f"feature groups do not cover the columns: missing={missing}, extra={extra}")


def branches(df: DataFrame, rules: FeatureRules, split: str = "split") -> dict[str, DataFrame]:
    """The shared, tree_no_log and native branches of one base; all fitting is on the train split."""
    coverage_contract(df, rules)
    base = df.drop(*rules.dropped)
    train = base.filter(F.col(split) == "train")
    categories = category_lists(train, rules.categorical)
    unfilled = [c for c in features_to_impute(train) if c not in rules.categorical]
    encoded = one_hot(base, categories)
    middles = _median_ends(train, unfilled)
    raw = {f: (low + high) / 2 for f, (low, high) in middles.items()}
    # log1p keeps the order of values: the logged median lies between the same two neighbours.
    logged = {
        f: (math.log1p(low) + math.log1p(high)) / 2 if f in rules.log else raw[f] for f, (low, high) in middles.items()
    }
    shared = log1p(encoded, rules.log) if rules.log else encoded
    return {
        "shared": impute(shared, logged),
        "tree_no_log": impute(encoded, raw),
        "native": base,
    }


def branch_manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """(branch, position, column_name, null_count) over all branches."""
    parts = []
    for name, df in frames.items():
        places = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns, start=1) for x in (c, i)])
        parts.append(
            null_counts(df).select(
                F.lit(name).alias("branch"),
                places[F.col("column_name")].cast("bigint").alias("position"),
                "column_name",
                "null_count",
            )
        )
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def missing_totals(frames: dict[str, DataFrame], split: str = "split") -> DataFrame:
    """(branch, dataset_split, missing_values): nulls over all columns."""
    result = None
    for name, df in frames.items():
        nulls = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
        part = df.groupBy(F.col(split).alias("dataset_split")).agg(F.sum(nulls).alias("missing_values"))
        part = part.select(F.lit(name).alias("branch"), "dataset_split", "missing_values")
        result = part if result is None else result.unionByName(part)
    return result


def with_weights(df: DataFrame, amount: str = "loan_amnt", method: str = "sqrt", output: str = "sample_weight") -> DataFrame:
    """Sample weights from the amount: sqrt, log (log1p) or raw; null or negative fails the job."""
    if method not in WEIGHT_METHODS:
        raise ValueError(f"method must be one of {WEIGHT_METHODS}")
    require_columns(df, amount)
    v = F.col(amount).cast("double")
    safe = ensure(v >= 0, v, f"{amount} must be present and not negative")
    shaped = {"sqrt": F.sqrt(safe), "log": F.log1p(safe), "raw": safe}[method]
    return df.withColumn(output, shaped)


def feature_columns(df: DataFrame, target: str = "target_default", keys: Sequence[str] = ("row_id", "split")) -> list[str]:
    """Model inputs: everything but target and keys."""
    gone = {target, *keys}
    return [c for c in df.columns if c not in gone]


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Feature vector column; nulls are refused."""
    from pyspark.ml.feature import VectorAssembler

    numbers = df.withColumns({f: F.col(f).cast("double") for f in features})
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(numbers)
