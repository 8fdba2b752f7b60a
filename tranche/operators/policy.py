"""Lending policies: accept by score or subgrade, count what was gained and lost, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tranche.functions import formats
from tranche.functions.guards import binary_target, ensure, not_null, require_columns
from tranche.functions.shape import record
from tranche.operators import ordered
from tranche.operators.cohort import split_rank
from tranche.operators.evaluation import subgrade_rank

# The published policy grids.
THRESHOLDS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45]
CUTOFFS = ["a5", "b5", "c5", "d5", "e5", "f5", "g5"]
# Marker of loans issued against the policy, and the two pricing groups.
EXCEPTION_MARK = "does_not_meet_the_credit_policy"
POLICY_GROUPS = ["standard_issued", "policy_exception_issued"]
# Display columns of the formatted outcome tables.
PERCENT_COLUMNS = ["acceptance_rate", "default_rate_among_accepted"]
MONEY_COLUMNS = [
    "accepted_loan_amnt",
    "accepted_default_loan_amnt",
    "rejected_non_default_loan_amnt",
    "net_value_proxy",
    "net_value_proxy_with_opportunity_cost",
]
DISPLAY_COLUMNS = ["policy_name", "policy_value", "dataset_name", "accepted_count", "rejected_count"]
MATCH_PERCENT_COLUMNS = [
    "baseline_acceptance_rate",
    "model_acceptance_rate",
    "acceptance_rate_diff",
    "baseline_default_rate",
    "model_default_rate",
    "default_rate_diff",
]
MATCH_MONEY_COLUMNS = [
    "baseline_net_value_proxy",
    "baseline_net_value_with_opportunity_cost",
    "model_net_value_proxy",
    "model_net_value_with_opportunity_cost",
    "net_value_proxy_diff",
    "net_value_with_opportunity_cost_diff",
]


def subgrade_number(name: str) -> int:
    """Rank 1..35 of a cutoff given as text, e.g. ``' C5 '``."""
    text = name.strip().lower()
    if len(text) != 2 or text[0] not in "abcdefg" or text[1] not in "12345":
        raise ValueError(f"unknown subgrade: {name!r}")
    return "abcdefg".index(text[0]) * 5 + int(text[1])


def _checked_threshold(threshold: float) -> float:
    if isinstance(threshold, bool) or not 0.0 <= float(threshold) <= 1.0:
        raise ValueError("threshold must lie in [0, 1]")
    return float(threshold)


def _decided(df: DataFrame, accept: Column) -> DataFrame:
    flag = accept.cast("int")
    return df.withColumns(
        {
            "accepted_flag": flag,
            "rejected_flag": F.lit(1) - flag,
            "decision_label": F.when(flag == 1, "accept").otherwise("reject"),
        }
    )


def threshold_policy(df: DataFrame, threshold: float, score: str = "predicted_default_probability") -> DataFrame:
    require_columns(df, score)
    limit = _checked_threshold(threshold)
    return _decided(df.withColumn("policy_threshold", F.lit(limit)), not_null(score) <= limit)


def cutoff_policy(df: DataFrame, cutoff: str, subgrade: str = "sub_grade") -> DataFrame:
    require_columns(df, subgrade)
    limit = subgrade_number(cutoff)
    ranked = df.withColumns(
        {
            "subgrade_rank": subgrade_rank(F.col(subgrade)),
            "cutoff_subgrade": F.lit(cutoff.strip().lower()),
            "cutoff_rank": F.lit(limit),
        }
    )
    return _decided(ranked, F.col("subgrade_rank") <= limit)


# --- outcomes -------------------------------------------------------------------------------


def _outcome_table(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 21 outcome columns from cells (keys, accepted, y, n, amount)."""
    taken, y = F.col("accepted"), F.col("y")

    def total(value: str, where: Column | None = None) -> Column:
        c = F.col(value) if where is None else F.when(where, F.col(value))
        return F.coalesce(F.sum(c), F.lit(0).cast("bigint" if value == "n" else "double"))

    quarters = {
        "accepted_default": taken & (y == 1),
        "accepted_non_default": taken & (y == 0),
        "rejected_non_default": ~taken & (y == 0),
        "rejected_default": ~taken & (y == 1),
    }
    summed = cells.groupBy(*keys).agg(
        total("n").alias("row_count"),
        total("n", taken).alias("accepted_count"),
        total("n", ~taken).alias("rejected_count"),
        *[total("n", where).alias(f"{name}_count") for name, where in quarters.items()],
        total("amount").alias("total_loan_amnt"),
        total("amount", taken).alias("accepted_loan_amnt"),
        total("amount", ~taken).alias("rejected_loan_amnt"),
        *[total("amount", where).alias(f"{name}_loan_amnt") for name, where in quarters.items()],
    )
    accepted = F.col("accepted_count")

    def of_accepted(count: str) -> Column:
        return F.when(accepted > 0, F.col(count) / accepted).otherwise(F.lit(0.0))

    return summed.select(
        *keys,
        "row_count",
        "accepted_count",
        "rejected_count",
        (accepted / F.col("row_count")).alias("acceptance_rate"),
        (F.col("rejected_count") / F.col("row_count")).alias("rejection_rate"),
        *[f"{name}_count" for name in quarters],
        of_accepted("accepted_default_count").alias("default_rate_among_accepted"),
        of_accepted("accepted_non_default_count").alias("non_default_rate_among_accepted"),
        "total_loan_amnt",
        "accepted_loan_amnt",
        "rejected_loan_amnt",
        *[f"{name}_loan_amnt" for name in quarters],
    )


def policy_outcomes(
    decisions: DataFrame,
    policy_name: str,
    policy_value,
    target: str = "target_default",
    amount: str = "loan_amnt",
    dataset: str = "split",
    accepted: str = "accepted_flag",
    rejected: str = "rejected_flag",
) -> DataFrame:
    """Outcome table of one decided policy, a row per dataset."""
    require_columns(decisions, target, amount, dataset, accepted, rejected)
    flags = F.col(accepted).isin(0, 1) & (F.col(accepted) + F.col(rejected) == 1)
    cells = (
        decisions.select(
            F.col(dataset).alias("dataset_name"),
            ensure(flags, F.col(accepted) == 1, "accepted and rejected flags must be 0/1 and complementary").alias("accepted"),
            binary_target(target).alias("y"),
            not_null(amount).cast("double").alias("amount"),
        )
        .groupBy("dataset_name", "accepted", "y")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
        .withColumns({"policy_name": F.lit(policy_name), "policy_value": F.lit(policy_value)})
    )
    return _outcome_table(cells, ["policy_name", "policy_value", "dataset_name"])


def _sweep(
    df: DataFrame, measure: Column, grid: Sequence[tuple], policy_name: str, target: str, amount: str, dataset: str
) -> DataFrame:
    """All policies ``measure <= limit`` of the grid in one pass over the rows.

    Each row falls into the first limit that accepts it. Rows are summed per limit, and only
    those few sums are repeated once per policy, so the cost does not grow with the grid.
    """
    grid = sorted(grid)
    step = sum(((F.lit(limit) < F.col("_m")).cast("int") for limit, _ in grid), F.lit(0))
    sums = (
        df.select(
            F.col(dataset).alias("dataset_name"),
            measure.alias("_m"),
            binary_target(target).alias("y"),
            not_null(amount).cast("double").alias("amount"),
        )
        .groupBy("dataset_name", step.alias("_step"), "y")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    )
    policies = F.array(*[record(place=i, policy_value=label) for i, (_, label) in enumerate(grid)])
    cells = sums.withColumn("_policy", F.explode(policies)).select(
        F.lit(policy_name).alias("policy_name"),
        F.col("_policy.policy_value").alias("policy_value"),
        "dataset_name",
        (F.col("_step") <= F.col("_policy.place")).alias("accepted"),
        "y",
        "n",
        "amount",
    )
    return _outcome_table(cells, ["policy_name", "policy_value", "dataset_name"])


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float] = tuple(THRESHOLDS),
    score: str = "predicted_default_probability",
    target: str = "target_default",
    amount: str = "loan_amnt",
    dataset: str = "split",
    policy_name: str = "model_threshold",
) -> DataFrame:
    require_columns(df, score, target, amount, dataset)
    grid = [(_checked_threshold(t), float(t)) for t in thresholds]
    return _sweep(df, not_null(score).cast("double"), grid, policy_name, target, amount, dataset)


def cutoff_sweep(
    df: DataFrame,
    cutoffs: Sequence[str] = tuple(CUTOFFS),
    subgrade: str = "sub_grade",
    target: str = "target_default",
    amount: str = "loan_amnt",
    dataset: str = "split",
    policy_name: str = "baseline_subgrade",
) -> DataFrame:
    require_columns(df, subgrade, target, amount, dataset)
    grid = [(subgrade_number(c), c.strip().lower()) for c in cutoffs]
    return _sweep(df, subgrade_rank(F.col(subgrade)), grid, policy_name, target, amount, dataset)


def outcome_artifact(*tables: DataFrame) -> DataFrame:
    """Union of outcome tables, ordered by dataset and policy value."""
    from tranche.operators.evaluation import combine

    return combine(tables).orderBy(split_rank("dataset_name"), "policy_value")


def with_net_value(outcomes: DataFrame) -> DataFrame:
    """Good money lent minus bad money lent, then minus good money turned away."""
    require_columns(outcomes, "accepted_non_default_loan_amnt", "accepted_default_loan_amnt", "rejected_non_default_loan_amnt")
    net = F.col("accepted_non_default_loan_amnt") - F.col("accepted_default_loan_amnt")
    return outcomes.withColumns(
        {
            "net_value_proxy": net,
            "net_value_proxy_with_opportunity_cost": net - F.col("rejected_non_default_loan_amnt"),
        }
    )


def format_outcomes(valued: DataFrame) -> DataFrame:
    return valued.select(
        *DISPLAY_COLUMNS,
        *[formats.percent(F.col(c)).alias(c) for c in PERCENT_COLUMNS],
        *[formats.money(F.col(c)).alias(c) for c in MONEY_COLUMNS],
    )


# --- comparison -----------------------------------------------------------------------------


def match_by_acceptance(model: DataFrame, baseline: DataFrame, dataset_name: str = "test") -> DataFrame:
    """For every baseline policy the model policy with the closest acceptance rate (lowest value on ties).

    The model side is a policy grid: one row per threshold whatever the number of loans, so it is
    carried as one short array per dataset and searched in place.
    """
    here = F.col("dataset_name") == dataset_name
    fields = ["policy_value", "acceptance_rate", "default_rate_among_accepted"]
    valued_model = with_net_value(model.filter(here))
    valued_base = with_net_value(baseline.filter(here))
    values = ["net_value_proxy", "net_value_proxy_with_opportunity_cost"]
    options = valued_model.groupBy("dataset_name").agg(
        F.collect_list(record(**{c: F.col(c) for c in [*fields, *values]})).alias("_options")
    )
    rate = F.col("acceptance_rate")
    nearest = F.array_min(
        F.transform(
            "_options",
            lambda o: record(gap=F.abs(o["acceptance_rate"] - rate), policy_value=o["policy_value"], model=o),
        )
    )["model"]
    joined = valued_base.join(options, "dataset_name").withColumn("_m", nearest)
    return joined.select(
        F.col("policy_value").alias("baseline_policy"),
        rate.alias("baseline_acceptance_rate"),
        F.col("default_rate_among_accepted").alias("baseline_default_rate"),
        F.col("net_value_proxy").alias("baseline_net_value_proxy"),
        F.col("net_value_proxy_with_opportunity_cost").alias("baseline_net_value_with_opportunity_cost"),
        F.col("_m.policy_value").alias("model_threshold"),
        F.col("_m.acceptance_rate").alias("model_acceptance_rate"),
        F.col("_m.default_rate_among_accepted").alias("model_default_rate"),
        F.col("_m.net_value_proxy").alias("model_net_value_proxy"),
        F.col("_m.net_value_proxy_with_opportunity_cost").alias("model_net_value_with_opportunity_cost"),
        (F.col("_m.acceptance_rate") - rate).alias("acceptance_rate_diff"),
        (F.col("_m.default_rate_among_accepted") - F.col("default_rate_among_accepted")).alias("default_rate_diff"),
        (F.col("_m.net_value_proxy") - F.col("net_value_proxy")).alias("net_value_proxy_diff"),
        (
            F.col("_m.net_value_proxy_with_opportunity_cost") - F.col("net_value_proxy_with_opportunity_cost")
        ).alias("net_value_with_opportunity_cost_diff"),
    ).orderBy("baseline_acceptance_rate")


def format_match(matched: DataFrame) -> DataFrame:
    shown = {c: formats.percent(F.col(c)) for c in MATCH_PERCENT_COLUMNS}
    shown.update({c: formats.money(F.col(c), sign_first=True) for c in MATCH_MONEY_COLUMNS})
    return matched.withColumns(shown)


def decision_points(
    matched: DataFrame, rows: int = 5, sort_by: str = "net_value_with_opportunity_cost_diff", ascending: bool = False
) -> DataFrame:
    """The report's top rows with formatted, renamed columns."""
    if rows <= 0:
        raise ValueError("rows must be positive")
    require_columns(matched, sort_by)
    order = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    return (
        matched.orderBy(order, "baseline_policy")
        .limit(rows)
        .select(
            formats.percent(F.col("baseline_acceptance_rate"), 1).alias("Acceptance Rate"),
            F.format_string("%.2f", "model_threshold").alias("Model Threshold"),
            formats.money(F.col("baseline_net_value_with_opportunity_cost"), True).alias("Baseline Proxy Value"),
            formats.money(F.col("model_net_value_with_opportunity_cost"), True).alias("Model Proxy Value"),
            formats.money(F.col("net_value_with_opportunity_cost_diff"), True).alias("Model Advantage"),
            formats.percent(F.col("default_rate_diff"), 2, signed=True).alias("Default Rate Gap"),
        )
    )


# --- policy exceptions ----------------------------------------------------------------------

EXCEPTION_METRICS = [
    "row_count",
    "population_share",
    "observed_default_rate",
    "predicted_default_probability_mean",
    "int_rate_mean",
    "int_rate_median",
    "loan_amnt_mean",
    "loan_amnt_median",
]


def exception_pricing(
    df: DataFrame,
    target: str = "target_default",
    status: str = "loan_status",
    score: str = "predicted_default_probability",
    interest_rate: str = "int_rate",
    amount: str = "loan_amnt",
    dataset: str = "split",
) -> DataFrame:
    """Risk and price of loans issued against the policy beside standard ones, per dataset."""
    require_columns(df, target, status, score, interest_rate, amount, dataset)
    is_exception = F.coalesce(F.col(status).ilike(f"%{EXCEPTION_MARK.replace('_', chr(92) + '_')}%"), F.lit(False))
    grouped = df.select(
        F.col(dataset).alias("dataset_name"),
        F.when(is_exception, POLICY_GROUPS[1]).otherwise(POLICY_GROUPS[0]).alias("policy_group"),
        F.col(target).alias("_y"),
        F.col(score).alias("_p"),
        F.col(interest_rate).cast("double").alias("int_rate_median"),
        F.col(amount).cast("double").alias("loan_amnt_median"),
    )
    by = ["dataset_name", "policy_group"]
    priced = ["int_rate_median", "loan_amnt_median"]
    long = grouped.select(*by, *priced).unpivot(by, priced, "metric", "value")
    medians = (
        ordered.exact_quantiles(long, [*by, "metric"], "value", [0.5])
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("metric") == m, F.col("quantile"))).alias(m) for m in priced])
    )
    summary = grouped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg("_y").alias("observed_default_rate"),
        F.avg("_p").alias("predicted_default_probability_mean"),
        F.avg("int_rate_median").alias("int_rate_mean"),
        F.avg("loan_amnt_median").alias("loan_amnt_mean"),
    )
    share = F.col("row_count") / F.sum("row_count").over(W.partitionBy("dataset_name"))
    return (
        summary.join(F.broadcast(medians), by, "left")
        .withColumn("population_share", share)
        .select(*by, *EXCEPTION_METRICS)
        .orderBy(split_rank("dataset_name"), split_rank("policy_group", POLICY_GROUPS))
    )


def exception_comparison(summary: DataFrame) -> DataFrame:
    """One row per dataset: every metric for both groups and four gaps; an absent group stays null."""
    require_columns(summary, "dataset_name", "policy_group")
    wide = summary.groupBy("dataset_name").agg(
        *[
            F.max(F.when(F.col("policy_group") == g, F.col(m))).alias(f"{m}_{g}")
            for m in EXCEPTION_METRICS
            for g in POLICY_GROUPS
        ]
    )

    def gap(metric: str) -> Column:
        return F.col(f"{metric}_{POLICY_GROUPS[1]}") - F.col(f"{metric}_{POLICY_GROUPS[0]}")

    return wide.withColumns(
        {
            "default_rate_gap": gap("observed_default_rate"),
            "predicted_risk_gap": gap("predicted_default_probability_mean"),
            "int_rate_mean_gap": gap("int_rate_mean"),
            "int_rate_median_gap": gap("int_rate_median"),
        }
    ).orderBy(split_rank("dataset_name"))


def _shown(metric: str, column: str) -> Column:
    c = F.col(column)
    if metric.startswith("int_rate"):
        return F.when(c.isNotNull(), formats.percent_points(c)).alias(column)
    if metric.startswith("loan_amnt"):
        return F.when(c.isNotNull(), formats.money(c)).alias(column)
    if metric == "row_count":
        return c
    return F.when(c.isNotNull(), formats.percent(c)).alias(column)


def format_exception_pricing(summary: DataFrame) -> DataFrame:
    return summary.select("dataset_name", "policy_group", *[_shown(m, m) for m in EXCEPTION_METRICS])


def format_exception_comparison(comparison: DataFrame) -> DataFrame:
    """Display columns of the comparison; values of an absent group stay null."""
    standard, exception = POLICY_GROUPS
    columns: list[Column] = [F.col("dataset_name")]
    for metric, gap in (
        ("row_count", None),
        ("population_share", None),
        ("observed_default_rate", "default_rate_gap"),
        ("predicted_default_probability_mean", "predicted_risk_gap"),
        ("int_rate_mean", "int_rate_mean_gap"),
    ):
        columns += [_shown(metric, f"{metric}_{standard}"), _shown(metric, f"{metric}_{exception}")]
        if gap:
            columns.append(_shown(metric, gap))
    return comparison.select(*columns)
