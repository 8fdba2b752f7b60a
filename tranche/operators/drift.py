"""Train against test: schema, structure, text and numeric drift.

All joins and windows here run on audit tables with one row per column of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tranche.functions.guards import require_columns
from tranche.functions.shape import fitted, local_table, record, rows_of
from tranche.functions.text import strip
from tranche.operators import profile

# Structural issues by severity, and the action recommended for each.
ISSUES = [
    "Present in train only",
    "Present in test only",
    "Dtype mismatch",
    "100% Null",
    "High Missing (>50%)",
    "Constant",
]
ACTIONS = {
    "Present in train only": "Drop ingestion artifact / align schema",
    "Present in test only": "Align schema (investigate source) / drop if absent in train",
    "Dtype mismatch": "Coerce to consistent dtype (string/category/numeric)",
    "100% Null": "Drop (non-informative in this cohort)",
    "High Missing (>50%)": "Flag as regime-shift sensitive; likely drop or isolate",
    "Constant": "Drop (non-informative)",
}
# Fixed value: null percent from which a column counts as mostly missing.
HIGH_MISSING = 50


def _xor(a: str = "present_in_train", b: str = "present_in_test") -> Column:
    return F.col(a) != F.col(b)


# --- schema ---------------------------------------------------------------------------------


def schema_compare(train: DataFrame, test: DataFrame) -> DataFrame:
    """(column_name, train_dtype, test_dtype, present_in_train, present_in_test, dtype_mismatch)."""
    a = profile.column_types(train).select("column_name", F.col("dtype").alias("train_dtype"))
    b = profile.column_types(test).select("column_name", F.col("dtype").alias("test_dtype"))
    return _with_presence(a.join(b, "column_name", "full"), "train_dtype", "test_dtype").orderBy("column_name")


def _with_presence(joined: DataFrame, train_type: str, test_type: str) -> DataFrame:
    in_train, in_test = F.col(train_type).isNotNull(), F.col(test_type).isNotNull()
    return joined.withColumns(
        {
            "present_in_train": in_train,
            "present_in_test": in_test,
            "dtype_mismatch": in_train & in_test & ~F.col(train_type).eqNullSafe(F.col(test_type)),
        }
    )


def schema_summary(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: rows and columns of both splits and the counts of schema differences."""
    compared = schema_compare(train, test).agg(
        F.count_if(F.col("present_in_train") & ~F.col("present_in_test")).alias("train_only_count"),
        F.count_if(~F.col("present_in_train") & F.col("present_in_test")).alias("test_only_count"),
        F.count_if("dtype_mismatch").alias("dtype_mismatch_count"),
    )
    rows = profile.dataset_overview(train, test)

    def of(split: str, column: str) -> Column:
        return F.max(F.when(F.col("dataset_split") == split, F.col(column)))

    sizes = rows.agg(
        of("train", "rows").alias("train_rows"),
        of("test", "rows").alias("test_rows"),
        of("train", "columns").alias("train_cols"),
        of("test", "columns").alias("test_cols"),
    )
    both = sizes.unionByName(compared, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def schema_deltas(compared: DataFrame) -> DataFrame:
    return compared.filter(_xor() | F.col("dtype_mismatch")).orderBy(F.desc("dtype_mismatch"), "column_name")


# --- structure ------------------------------------------------------------------------------


def feature_universe(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both inspections and the schema comparison side by side, worst columns first."""
    sides = []
    for name, df in (("train", train), ("test", test)):
        inspected = profile.inspect(df).drop("dtype", "null_count")
        sides.append(inspected.select("column_name", *[F.col(c).alias(f"{name}_{c}") for c in inspected.columns[1:]]))
    joined = sides[0].join(sides[1], "column_name", "full").join(schema_compare(train, test), "column_name", "left")
    table = joined.withColumns(
        {
            "max_null_percent": F.greatest("train_null_percent", "test_null_percent"),
            "null_gap_test_minus_train": F.col("test_null_percent") - F.col("train_null_percent"),
        }
    )
    return table.orderBy(F.desc(_universe_severity()), F.desc_nulls_last("max_null_percent"), "column_name")


def _points(condition: Column, points: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)


def _either(flag: str) -> Column:
    return F.coalesce(F.col(f"train_{flag}"), F.lit(False)) | F.coalesce(F.col(f"test_{flag}"), F.lit(False))


def _universe_severity() -> Column:
    return (
        _points(F.col("dtype_mismatch"), 100)
        + _points(_xor(), 80)
        + _points(_either("is_fully_null"), 60)
        + _points(_either("is_constant"), 40)
        + _points(F.col("max_null_percent") >= HIGH_MISSING, 10)
    )


def action_list(universe: DataFrame) -> DataFrame:
    """Universe rows that need a decision."""
    wanted = F.col("dtype_mismatch") | _xor() | (F.col("max_null_percent") >= HIGH_MISSING) | _either("is_constant")
    return (
        universe.filter(F.coalesce(wanted, F.lit(False)))
        .select(
            "column_name",
            "present_in_train",
            "present_in_test",
            "train_dtype",
            "test_dtype",
            "dtype_mismatch",
            "train_null_percent",
            "test_null_percent",
            "max_null_percent",
            "null_gap_test_minus_train",
            "train_is_fully_null",
            "test_is_fully_null",
            "train_is_constant",
            "test_is_constant",
        )
        .orderBy(F.desc("dtype_mismatch"), F.desc_nulls_last("max_null_percent"), "column_name")
    )


def structural_issues(universe: DataFrame) -> DataFrame:
    """(column_name, issue, applies_to): no to several issues per column, by severity."""
    in_train, in_test = F.col("present_in_train"), F.col("present_in_test")
    found = [
        (in_train & ~in_test, ISSUES[0], "train"),
        (in_test & ~in_train, ISSUES[1], "test"),
        (F.col("dtype_mismatch"), ISSUES[2], "both"),
    ]
    for split, present in (("train", in_train), ("test", in_test)):
        full = F.col(f"{split}_is_fully_null")
        found += [
            (present & full, ISSUES[3], split),
            (present & ~full & (F.col(f"{split}_null_percent") >= HIGH_MISSING), ISSUES[4], split),
            (present & F.col(f"{split}_is_constant"), ISSUES[5], split),
        ]
    entries = F.array(*[F.when(when, record(issue=issue, applies_to=split)) for when, issue, split in found])
    return (
        universe.select("column_name", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("_e"))
        .select("column_name", "_e.issue", "_e.applies_to")
        .orderBy(_issue_rank(), "column_name", "applies_to")
    )


def _issue_rank() -> Column:
    return F.array_position(F.array(*[F.lit(i) for i in ISSUES]), F.col("issue"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "issue")


def issue_examples(issues: DataFrame, per_issue: int = 5) -> DataFrame:
    place = F.row_number().over(W.partitionBy("issue").orderBy("column_name", "applies_to"))
    return (
        issues.withColumn("_place", place)
        .filter(F.col("_place") <= per_issue)
        .drop("_place")
        .orderBy(_issue_rank(), "column_name", "applies_to")
    )


def decision_queue(issues: DataFrame) -> DataFrame:
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return (
        issues.withColumn("recommended_action", actions[F.col("issue")])
        .dropDuplicates(["column_name", "issue", "applies_to"])
        .orderBy(_issue_rank(), "column_name", "applies_to")
    )


def group_coverage(df: DataFrame, groups: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """How the listed feature groups cover the columns of ``df``, with the values behind them."""
    listed = [{"feature_group": g, "feature_name": c} for g, columns in groups.items() for c in columns]
    config = local_table(df.sparkSession, listed, "feature_group string, feature_name string")
    values = rows_of(
        df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]),
        [],
        [record(feature_name=c, non_null_values=F.col(c)) for c in df.columns],
    )
    summary = config.join(values, "feature_name", "left").select(
        "feature_group",
        "feature_name",
        F.col("non_null_values").isNotNull().alias("present_in_dataset"),
        F.coalesce("non_null_values", F.lit(0)).alias("non_null_values"),
    )
    coverage = summary.groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("grouped_feature_count"),
        F.count_if("present_in_dataset").alias("present_feature_count"),
        F.count_if(~F.col("present_in_dataset")).alias("missing_feature_count"),
        F.sum("non_null_values").alias("non_null_values"),
    )
    repeated = config.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("feature_name")
    return {
        "coverage_summary": coverage.orderBy("feature_group"),
        "feature_group_summary": summary.orderBy("feature_group", "feature_name"),
        "duplicate_grouped_columns": repeated.orderBy("feature_name"),
        "ungrouped_columns": values.join(config, "feature_name", "left_anti").orderBy("feature_name"),
    }


def model_feature_audit(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Type, kind and distinct values of every feature in both splits."""
    require_columns(train, target)
    require_columns(test, target)
    columns = [c for c in train.columns if c != target]
    if columns != [c for c in test.columns if c != target]:
        raise ValueError("train and test features are not in the same order")
    tagged = [
        profile.value_counts(df, columns).filter(F.col("value").isNotNull()).select("column_name", "value", F.lit(s).alias("s"))
        for s, df in (("train", train), ("test", test))
    ]
    distinct = (
        tagged[0].unionByName(tagged[1])
        .groupBy("column_name", "value")
        .agg(F.max((F.col("s") == "train").cast("bigint")).alias("a"), F.max((F.col("s") == "test").cast("bigint")).alias("b"))
        .groupBy("column_name")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("both"))
    )
    numeric = profile.numeric_columns(train)
    flags = [c for c, t in train.dtypes if t == "boolean"]
    name = F.col("column_name")
    is_numeric = name.isin(numeric) if numeric else F.lit(False)
    kind = F.when(name.isin(flags) if flags else F.lit(False), "boolean").when(is_numeric, "numeric").otherwise("categorical")
    values = F.coalesce("both", F.lit(0))
    return (
        schema_compare(train.select(columns), test.select(columns))
        .join(distinct, "column_name", "left")
        .select(
            name.alias("feature_name"),
            "train_dtype",
            "test_dtype",
            kind.alias("feature_group"),
            ((is_numeric | (kind == "boolean")) & (values <= 2)).alias("is_binary"),
            F.coalesce("a", F.lit(0)).alias("train_non_null_unique_values"),
            F.coalesce("b", F.lit(0)).alias("test_non_null_unique_values"),
            F.col("dtype_mismatch").alias("requires_manual_review"),
        )
        .orderBy("feature_group", "feature_name")
    )


# --- value drift ----------------------------------------------------------------------------


def compare_values(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """(value, present_in_training, present_in_test) over the stripped values of both sides."""
    for df in (train, test):
        require_columns(df, column)
    sides = [
        df.filter(F.col(column).isNotNull()).select(strip(F.col(column)).alias("value"), F.lit(s).alias("s"))
        for s, df in (("train", train), ("test", test))
    ]
    return (
        sides[0].unionByName(sides[1])
        .groupBy("value")
        .agg(
            F.max(F.col("s") == "train").alias("present_in_training"),
            F.max(F.col("s") == "test").alias("present_in_test"),
        )
        .orderBy("value")
    )


def string_audits(train: DataFrame, test: DataFrame, sample_size: int = 5) -> DataFrame:
    return profile.audit_strings(train, sample_size).withColumn("split", F.lit("train")).unionByName(
        profile.audit_strings(test, sample_size).withColumn("split", F.lit("test"))
    )


def numeric_audits(train: DataFrame, test: DataFrame) -> DataFrame:
    return profile.audit_numbers(train).withColumn("split", F.lit("train")).unionByName(
        profile.audit_numbers(test).withColumn("split", F.lit("test"))
    )


_RENAMED = {"unique_count_including_null": "unique_including_null", "unique_count_non_null": "unique_non_null"}


def _side_by_side(audits: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Audit rows of both splits pivoted to ``<measure>_train`` and ``<measure>_test``."""
    wide = audits.groupBy("column_name").agg(
        *[
            F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{_RENAMED.get(m, m)}_{s}")
            for s in ("train", "test")
            for m in measures
        ]
    )
    gap = {
        "unique_non_null_gap_test_minus_train": F.coalesce("unique_non_null_test", F.lit(0))
        - F.coalesce("unique_non_null_train", F.lit(0)),
        "null_gap_test_minus_train": F.col("null_percent_test") - F.col("null_percent_train"),
        "max_null_percent": F.greatest("null_percent_train", "null_percent_test"),
    }
    return _with_presence(wide, "dtype_train", "dtype_test").withColumns(gap)


def _differs(measure: str, digits: int) -> Column:
    return ~F.round(F.col(f"{measure}_train"), digits).eqNullSafe(F.round(F.col(f"{measure}_test"), digits))


def align_strings(audits: DataFrame) -> DataFrame:
    table = _side_by_side(
        audits, ["dtype", "unique_count_including_null", "unique_count_non_null", "null_percent", "sample_values"]
    )
    changed = (
        _xor()
        | F.col("dtype_mismatch")
        | ~F.col("unique_non_null_train").eqNullSafe(F.col("unique_non_null_test"))
        | _differs("null_percent", 2)
    )
    return table.withColumn("has_difference", changed).orderBy("column_name")


def align_numbers(audits: DataFrame) -> DataFrame:
    """As :func:`align_strings` with gaps of the statistics; distinct counts, min and max do not count as drift."""
    stats = ["mean", "median", "std", "min", "max"]
    table = _side_by_side(
        audits, ["dtype", "unique_count_including_null", "unique_count_non_null", "null_percent", *stats]
    ).withColumns({f"{s}_gap_test_minus_train": F.col(f"{s}_test") - F.col(f"{s}_train") for s in stats})
    changed = _xor() | F.col("dtype_mismatch") | _differs("null_percent", 2)
    for s in ("mean", "median", "std"):
        changed = changed | _differs(s, 6)
    return table.withColumn("has_difference", changed).orderBy("column_name")


def _top(deltas: DataFrame, score: Column, gaps: Sequence[str], k: int) -> DataFrame:
    if k <= 0:
        raise ValueError("k must be positive")
    order = [F.desc("severity_score"), *[F.desc_nulls_last(F.abs(F.col(g))) for g in gaps], F.asc("column_name")]
    return deltas.withColumn("severity_score", score).orderBy(*order).limit(k)


def top_string_deltas(deltas: DataFrame, k: int = 10) -> DataFrame:
    score = (
        _points(_xor(), 100)
        + _points(F.col("dtype_mismatch"), 60)
        + _points(F.abs("null_gap_test_minus_train") >= 5, 20)
        + _points(F.abs("unique_non_null_gap_test_minus_train") >= 10, 10)
    )
    return _top(deltas, score, ["null_gap_test_minus_train", "unique_non_null_gap_test_minus_train"], k)


def top_numeric_deltas(deltas: DataFrame, k: int = 10) -> DataFrame:
    gaps = [f"{s}_gap_test_minus_train" for s in ("mean", "median", "std")]
    score = (
        _points(_xor(), 100) + _points(F.col("dtype_mismatch"), 60) + _points(F.abs("null_gap_test_minus_train") >= 5, 20)
    )
    for g in gaps:
        score = score + _points(F.abs(F.col(g)) > 0, 10)
    return _top(deltas, score, ["null_gap_test_minus_train", *gaps], k)


def value_differences(
    train: DataFrame, test: DataFrame, top: DataFrame, columns: int = 5, per_side: int = 10
) -> DataFrame:
    """(column_name, value, present_in) for the first ``columns`` of ``top``.

    Up to ``per_side`` values that only one split has; columns of a single split give their
    smallest values. All columns are compared in one grouped pass.
    """
    if columns <= 0:
        return local_table(train.sparkSession, [], "column_name string, value string, present_in string")
    chosen = top.limit(columns).select("column_name")
    counted = []
    for name, df in (("train", train), ("test", test)):
        text = profile.string_columns(df)
        counted.append(
            profile.value_counts(df, text)
            .filter(F.col("value").isNotNull())
            .select("column_name", strip(F.col("value")).alias("value"), F.lit(name).alias("side"))
        )
    seen = (
        counted[0].unionByName(counted[1])
        # The chosen columns are at most ``columns`` names.
        .join(F.broadcast(chosen), "column_name", "left_semi")
        .groupBy("column_name", "value")
        .agg(F.min("side").alias("first_side"), F.max("side").alias("last_side"))
        .filter(F.col("first_side") == F.col("last_side"))
        .select("column_name", "value", F.concat("first_side", F.lit("_only")).alias("present_in"))
    )
    place = F.row_number().over(W.partitionBy("column_name", "present_in").orderBy("value"))
    return seen.withColumn("_place", place).filter(F.col("_place") <= per_side).drop("_place")


def string_drift_report(
    train: DataFrame,
    test: DataFrame,
    sample_size: int = 5,
    top_k: int = 10,
    drill_columns: int = 5,
    drill_values: int = 10,
    export_dir: str | None = None,
    base_name: str = "string_alignment",
    tag: str | None = None,
) -> dict[str, DataFrame]:
    """summary, deltas, top_deltas and value_differences; also written as CSV when a folder is given."""
    if drill_columns < 0 or drill_values <= 0:
        raise ValueError("drill_columns must not be negative and drill_values must be positive")
    audits = fitted(string_audits(train, test, sample_size))  # a row for each column and split
    combined = align_strings(audits)
    deltas = combined.filter("has_difference")
    top = top_string_deltas(deltas, top_k)
    report = {
        "summary": _report_summary(audits, combined, "string_like_cols", top_k),
        "deltas": deltas,
        "top_deltas": top.drop("severity_score"),
        "value_differences": value_differences(train, test, top, drill_columns, drill_values),
    }
    if export_dir:
        from tranche.sources.reports import export_string_report

        export_string_report(report, export_dir, base_name, tag)
    return report


def numeric_drift_report(
    train: DataFrame,
    test: DataFrame,
    top_k: int = 10,
    export_dir: str | None = None,
    base_name: str = "numerical_alignment",
    tag: str | None = None,
) -> dict[str, DataFrame]:
    audits = fitted(numeric_audits(train, test))  # a row for each column and split
    combined = align_numbers(audits)
    deltas = combined.filter("has_difference")
    report = {
        "summary": _report_summary(audits, combined, "numeric_cols", top_k),
        "deltas": deltas,
        "top_deltas": top_numeric_deltas(deltas, top_k).drop("severity_score"),
    }
    if export_dir:
        from tranche.sources.reports import export_numeric_report

        export_numeric_report(report, export_dir, base_name, tag)
    return report


def _report_summary(audits: DataFrame, combined: DataFrame, prefix: str, top_k: int) -> DataFrame:
    changed = F.count_if("has_difference")
    return combined.agg(
        F.count_if("present_in_train").alias(f"{prefix}_train"),
        F.count_if("present_in_test").alias(f"{prefix}_test"),
        F.count(F.lit(1)).alias(f"{prefix}_union"),
        changed.alias(f"{prefix}_with_differences"),
        F.least(changed, F.lit(top_k).cast("bigint")).alias("top_k_returned"),
    )
