"""Catalogue: lending policies and pricing (P), figure data (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tranche.operators import cohort, evaluation, figures, policy, validation
from tranche.plans.evaluation_queries import (
    MODELS_SQL,
    OUTCOMES_SQL,
    PIVOT_SQL,
    RATES_SQL,
    SHARES_SQL,
    calibration_sql,
    outcome_table,
    roc_sql,
    scored_loans,
    stored_scores,
    two_models,
)
from tranche.plans.loans import clean_loans, modeled_loans, raw_loans
from tranche.plans.registry import check, n, query, r, rounded

_RANK = "((ASCII(sub_grade) - ASCII('a')) * 5 + CAST(sub_grade[2] AS INT))"


def _decided_sql(extra: str, accept: str, select: str) -> str:
    return f"""SELECT split, row_id, {extra}, CAST({accept} AS INT) AS accepted_flag, 1 - CAST({accept} AS INT) AS rejected_flag,
        CASE WHEN {accept} THEN 'accept' ELSE 'reject' END AS decision_label FROM {select}"""


@query("p1_threshold_policy", check(_decided_sql("CAST(0.25 AS DOUBLE) AS policy_threshold", "score <= 0.25", "m")))
def p1_threshold_policy(spark, sf_dir):
    decided = policy.threshold_policy(scored_loans(spark, sf_dir), 0.25)
    return decided.select("split", "row_id", "policy_threshold", "accepted_flag", "rejected_flag", "decision_label")


@query("p2_cutoff_policy", check(_decided_sql(f"CAST({_RANK} AS INT) AS subgrade_rank", f"{_RANK} <= 15", "m")))
def p2_cutoff_policy(spark, sf_dir):
    decided = policy.cutoff_policy(modeled_loans(raw_loans(spark, sf_dir)), " C5 ")
    return decided.select("split", "row_id", "subgrade_rank", "accepted_flag", "rejected_flag", "decision_label")


def _quarter(where: str) -> tuple[str, str]:
    return f"COUNT(*) FILTER (WHERE {where})", f"COALESCE(SUM(loan_amnt) FILTER (WHERE {where}), 0)"


def _outcomes_sql(name: str, source: str, label: str) -> str:
    """The 21 outcome columns by plain filtered aggregates over (policy, loan) pairs."""
    quarters = {
        "accepted_default": "ok AND y = 1",
        "accepted_non_default": "ok AND y = 0",
        "rejected_non_default": "NOT ok AND y = 0",
        "rejected_default": "NOT ok AND y = 1",
    }
    counts = ", ".join(f"{_quarter(w)[0]} AS {q}_count" for q, w in quarters.items())
    amounts = ", ".join(f"{r(_quarter(w)[1], 2)} AS {q}_loan_amnt" for q, w in quarters.items())
    rate = "CASE WHEN COUNT(*) FILTER (WHERE ok) > 0 THEN COUNT(*) FILTER (WHERE ok AND y = {y}) / COUNT(*) FILTER (WHERE ok) ELSE 0 END"
    return f"""{name} AS (SELECT '{label}' AS policy_name, policy_value, dataset_name, COUNT(*) AS row_count,
        COUNT(*) FILTER (WHERE ok) AS accepted_count, COUNT(*) FILTER (WHERE NOT ok) AS rejected_count,
        COUNT(*) FILTER (WHERE ok) / COUNT(*) AS acceptance_rate, COUNT(*) FILTER (WHERE NOT ok) / COUNT(*) AS rejection_rate,
        {counts}, {rate.format(y=1)} AS default_rate_among_accepted, {rate.format(y=0)} AS non_default_rate_among_accepted,
        {r('SUM(loan_amnt)', 2)} AS total_loan_amnt, {r('COALESCE(SUM(loan_amnt) FILTER (WHERE ok), 0)', 2)} AS accepted_loan_amnt,
        {r('COALESCE(SUM(loan_amnt) FILTER (WHERE NOT ok), 0)', 2)} AS rejected_loan_amnt, {amounts}
        FROM {source} GROUP BY policy_value, dataset_name)"""


_THRESHOLD_VALUES = ", ".join(f"(CAST({t} AS DOUBLE))" for t in policy.THRESHOLDS)
_CUTOFF_VALUES = ", ".join(f"('{c}', {policy.subgrade_number(c)})" for c in policy.CUTOFFS)
_PAIRS_SQL = (
    f"""model_pairs AS (SELECT t.v AS policy_value, split AS dataset_name, target_default AS y, loan_amnt, score <= t.v AS ok
        FROM m, (VALUES {_THRESHOLD_VALUES}) t(v))""",
    f"""base_pairs AS (SELECT t.v AS policy_value, split AS dataset_name, target_default AS y, loan_amnt, {_RANK} <= t.k AS ok
        FROM m, (VALUES {_CUTOFF_VALUES}) t(v, k))""",
    _outcomes_sql("model_outcomes", "model_pairs", "model_threshold"),
    _outcomes_sql("base_outcomes", "base_pairs", "baseline_subgrade"),
)
_NET = """*, ROUND(accepted_non_default_loan_amnt - accepted_default_loan_amnt, 2) AS net_value_proxy,
    ROUND(accepted_non_default_loan_amnt - accepted_default_loan_amnt - rejected_non_default_loan_amnt, 2) AS net_value_proxy_with_opportunity_cost"""
_VALUED_SQL = (
    *_PAIRS_SQL,
    f"model_valued AS (SELECT {_NET} FROM model_outcomes)",
    f"base_valued AS (SELECT {_NET} FROM base_outcomes)",
)


_RATES = ["acceptance_rate", "rejection_rate", "default_rate_among_accepted", "non_default_rate_among_accepted"]


def _final(table: str, where: str = "", rates=tuple(_RATES)) -> str:
    """Rates are rounded last: what is displayed or compared must not be rounded twice."""
    return f"SELECT * REPLACE ({', '.join(f'{r(c)} AS {c}' for c in rates)}) FROM {table} {where}"


def money_rounded(df):
    money = [c for c in df.columns if c.endswith("_loan_amnt") or "net_value" in c]
    return df.withColumns({c: F.round(c, 2) for c in money})


def outcomes_rounded(df):
    return rounded(money_rounded(df))


def model_sweep(spark, sf_dir):
    return policy.threshold_sweep(scored_loans(spark, sf_dir))


def base_sweep(spark, sf_dir):
    return policy.cutoff_sweep(modeled_loans(raw_loans(spark, sf_dir)))


@query("p3_policy_outcomes", check(_final("model_outcomes", "WHERE policy_value = 0.25"), *_PAIRS_SQL))
def p3_policy_outcomes(spark, sf_dir):
    decided = policy.threshold_policy(scored_loans(spark, sf_dir), 0.25)
    return outcomes_rounded(policy.policy_outcomes(decided, "model_threshold", 0.25))


@query("p4_threshold_sweep", check(_final("model_outcomes"), *_PAIRS_SQL))
def p4_threshold_sweep(spark, sf_dir):
    return outcomes_rounded(model_sweep(spark, sf_dir))


@query("p5_cutoff_sweep", check(_final("base_outcomes"), *_PAIRS_SQL))
def p5_cutoff_sweep(spark, sf_dir):
    return outcomes_rounded(base_sweep(spark, sf_dir))


@query("p6_model_artifact", check(_final("model_outcomes"), *_PAIRS_SQL))
def p6_model_artifact(spark, sf_dir):
    return outcomes_rounded(policy.outcome_artifact(model_sweep(spark, sf_dir)))


@query("p7_baseline_artifact", check(_final("base_outcomes"), *_PAIRS_SQL))
def p7_baseline_artifact(spark, sf_dir):
    return outcomes_rounded(policy.outcome_artifact(base_sweep(spark, sf_dir)))


@query("p8_net_value_model", check(_final("model_valued"), *_VALUED_SQL))
def p8_net_value_model(spark, sf_dir):
    return outcomes_rounded(policy.with_net_value(model_sweep(spark, sf_dir)))


@query("p9_net_value_baseline", check(_final("base_valued"), *_VALUED_SQL))
def p9_net_value_baseline(spark, sf_dir):
    return outcomes_rounded(policy.with_net_value(base_sweep(spark, sf_dir)))


def _percent_sql(c: str, digits: int = 2) -> str:
    return f"format('{{:.{digits}f}}%', {c} * 100)"


def _money_sql(c: str, sign_first: bool = False) -> str:
    plain = f"format('${{:,}}', CAST(ROUND({c}) AS BIGINT))"
    if not sign_first:
        return plain
    return f"CASE WHEN {c} < 0 THEN format('-${{:,}}', CAST(ROUND(-({c})) AS BIGINT)) ELSE {plain} END"


def _display_sql(table: str) -> str:
    shown = [*policy.DISPLAY_COLUMNS]
    shown += [f"{_percent_sql(c)} AS {c}" for c in policy.PERCENT_COLUMNS]
    shown += [f"{_money_sql(c)} AS {c}" for c in policy.MONEY_COLUMNS]
    return f"SELECT {', '.join(shown)} FROM {table}"


@query("p10_format_model", check(_display_sql("model_valued"), *_VALUED_SQL))
def p10_format_model(spark, sf_dir):
    return policy.format_outcomes(money_rounded(policy.with_net_value(model_sweep(spark, sf_dir))))


@query("p11_format_baseline", check(_display_sql("base_valued"), *_VALUED_SQL))
def p11_format_baseline(spark, sf_dir):
    return policy.format_outcomes(money_rounded(policy.with_net_value(base_sweep(spark, sf_dir))))


_OPPORTUNITY = "net_value_proxy_with_opportunity_cost"
_MATCH_SQL = (
    *_VALUED_SQL,
    f"""matched AS (SELECT b.policy_value AS baseline_policy, b.acceptance_rate AS baseline_acceptance_rate,
        b.default_rate_among_accepted AS baseline_default_rate, b.net_value_proxy AS baseline_net_value_proxy,
        b.{_OPPORTUNITY} AS baseline_net_value_with_opportunity_cost, t.policy_value AS model_threshold,
        t.acceptance_rate AS model_acceptance_rate, t.default_rate_among_accepted AS model_default_rate,
        t.net_value_proxy AS model_net_value_proxy, t.{_OPPORTUNITY} AS model_net_value_with_opportunity_cost,
        t.acceptance_rate - b.acceptance_rate AS acceptance_rate_diff,
        t.default_rate_among_accepted - b.default_rate_among_accepted AS default_rate_diff,
        {r('t.net_value_proxy - b.net_value_proxy', 2)} AS net_value_proxy_diff,
        {r(f't.{_OPPORTUNITY} - b.{_OPPORTUNITY}', 2)} AS net_value_with_opportunity_cost_diff
        FROM base_valued b JOIN model_valued t USING (dataset_name) WHERE dataset_name = 'test'
        QUALIFY ROW_NUMBER() OVER (PARTITION BY b.policy_value ORDER BY ABS(t.acceptance_rate - b.acceptance_rate), t.policy_value) = 1)""",
)


def _matched(spark, sf_dir):
    model = money_rounded(model_sweep(spark, sf_dir))
    return money_rounded(policy.match_by_acceptance(model, money_rounded(base_sweep(spark, sf_dir))))


@query("p12_matched_policies", check(_final("matched", rates=policy.MATCH_PERCENT_COLUMNS), *_MATCH_SQL))
def p12_matched_policies(spark, sf_dir):
    return rounded(_matched(spark, sf_dir))


_MATCH_SHOWN = ", ".join(
    ["baseline_policy", "model_threshold"]
    + [f"{_percent_sql(c)} AS {c}" for c in policy.MATCH_PERCENT_COLUMNS]
    + [f"{_money_sql(c, True)} AS {c}" for c in policy.MATCH_MONEY_COLUMNS]
)


@query("p13_format_matched", check(f"SELECT {_MATCH_SHOWN} FROM matched", *_MATCH_SQL))
def p13_format_matched(spark, sf_dir):
    return policy.format_match(_matched(spark, sf_dir))


_PRICE_KEYS = "dataset_name, policy_group"
_PRICE_SQL = (
    f"""prices AS (SELECT split AS dataset_name, CASE WHEN loan_status LIKE '%does_not_meet_the_credit_policy%' THEN 'policy_exception_issued'
        ELSE 'standard_issued' END AS policy_group, COUNT(*) AS row_count,
        {r('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY split)')} AS population_share,
        {r('AVG(target_default)')} AS observed_default_rate, {r('AVG(score)')} AS predicted_default_probability_mean,
        {r('AVG(int_rate)')} AS int_rate_mean, {r('MEDIAN(int_rate)')} AS int_rate_median,
        {r('AVG(loan_amnt)')} AS loan_amnt_mean, {r('MEDIAN(loan_amnt)')} AS loan_amnt_median FROM m GROUP BY 1, 2)""",
)
_WIDE = ", ".join(
    f"MAX({metric}) FILTER (WHERE policy_group = '{g}') AS {metric}_{g}"
    for metric in policy.EXCEPTION_METRICS
    for g in policy.POLICY_GROUPS
)
_GAPS = ", ".join(
    f"{r(f'{metric}_policy_exception_issued - {metric}_standard_issued')} AS {name}"
    for metric, name in (
        ("observed_default_rate", "default_rate_gap"),
        ("predicted_default_probability_mean", "predicted_risk_gap"),
        ("int_rate_mean", "int_rate_mean_gap"),
        ("int_rate_median", "int_rate_median_gap"),
    )
)
_COMPARE_SQL = (
    *_PRICE_SQL,
    f"wide AS (SELECT dataset_name, {_WIDE} FROM prices GROUP BY dataset_name)",
    f"compared AS (SELECT *, {_GAPS} FROM wide)",
)


def _pricing(spark, sf_dir):
    return rounded(policy.exception_pricing(scored_loans(spark, sf_dir)))


@query("p14_exception_pricing", check("SELECT * FROM prices", *_PRICE_SQL))
def p14_exception_pricing(spark, sf_dir):
    return _pricing(spark, sf_dir)


@query("p15_exception_comparison", check("SELECT * FROM compared", *_COMPARE_SQL))
def p15_exception_comparison(spark, sf_dir):
    return rounded(policy.exception_comparison(_pricing(spark, sf_dir)))


def _shown_sql(metric: str, column: str) -> str:
    if metric.startswith("int_rate"):
        return f"CASE WHEN {column} IS NOT NULL THEN format('{{:.2f}}%', {column}) END AS {column}"
    if metric.startswith("loan_amnt"):
        return f"CASE WHEN {column} IS NOT NULL THEN {_money_sql(column)} END AS {column}"
    if metric == "row_count":
        return column
    return f"CASE WHEN {column} IS NOT NULL THEN {_percent_sql(column)} END AS {column}"


@query(
    "p16_format_exception_pricing",
    check(
        f"SELECT {_PRICE_KEYS}, " + ", ".join(_shown_sql(x, x) for x in policy.EXCEPTION_METRICS) + " FROM prices",
        *_PRICE_SQL,
    ),
)
def p16_format_exception_pricing(spark, sf_dir):
    return policy.format_exception_pricing(_pricing(spark, sf_dir))


_COMPARISON_SHOWN = ["dataset_name"]
for _metric, _gap in (
    ("row_count", None),
    ("population_share", None),
    ("observed_default_rate", "default_rate_gap"),
    ("predicted_default_probability_mean", "predicted_risk_gap"),
    ("int_rate_mean", "int_rate_mean_gap"),
):
    _COMPARISON_SHOWN += [_shown_sql(_metric, f"{_metric}_{g}") for g in policy.POLICY_GROUPS]
    if _gap:
        _COMPARISON_SHOWN.append(_shown_sql(_metric, _gap))


@query("p17_format_exception_comparison", check(f"SELECT {', '.join(_COMPARISON_SHOWN)} FROM compared", *_COMPARE_SQL))
def p17_format_exception_comparison(spark, sf_dir):
    return policy.format_exception_comparison(rounded(policy.exception_comparison(_pricing(spark, sf_dir))))


_BAND_SOURCE = "scored AS (SELECT split AS dataset_name, target_default AS y, score AS p, int_rate FROM m)"
_BANDS_SQL = (
    _BAND_SOURCE,
    *calibration_sql(
        "bands",
        "scored",
        "dataset_name",
        extra=f", {r('AVG(int_rate) / 100')} AS int_rate_mean, {r('MEDIAN(int_rate) / 100')} AS int_rate_median",
    ),
)
_BANDS_SELECT = """SELECT dataset_name, bin_order AS band_order, bin_low, bin_high, row_count AS loan_count,
    predicted_probability_mean AS predicted_default_probability_mean, observed_default_rate"""


def _bands(spark, sf_dir, interest_rate=None):
    labelled = stored_scores(spark, sf_dir, *([interest_rate] if interest_rate else []))
    return rounded(evaluation.risk_bands(labelled, interest_rate=interest_rate))


@query("p18_risk_bands", check(_BANDS_SELECT + " FROM bands", *_BANDS_SQL))
def p18_risk_bands(spark, sf_dir):
    return _bands(spark, sf_dir).drop("risk_band")


@query("p18_risk_bands_with_pricing", check(_BANDS_SELECT + ", int_rate_mean, int_rate_median FROM bands", *_BANDS_SQL))
def p18_risk_bands_with_pricing(spark, sf_dir):
    return _bands(spark, sf_dir, "int_rate").drop("risk_band")


@query(
    "p19_decision_points",
    check(
        f"""SELECT {_percent_sql('baseline_acceptance_rate', 1)} AS "Acceptance Rate", format('{{:.2f}}', model_threshold) AS "Model Threshold",
            {_money_sql('baseline_net_value_with_opportunity_cost', True)} AS "Baseline Proxy Value",
            {_money_sql('model_net_value_with_opportunity_cost', True)} AS "Model Proxy Value",
            {_money_sql('net_value_with_opportunity_cost_diff', True)} AS "Model Advantage",
            format('{{:+.2f}}%', default_rate_diff * 100) AS "Default Rate Gap"
            FROM matched ORDER BY net_value_with_opportunity_cost_diff DESC, baseline_policy LIMIT 5""",
        *_MATCH_SQL,
    ),
)
def p19_decision_points(spark, sf_dir):
    return policy.decision_points(_matched(spark, sf_dir))


# --- figure data ----------------------------------------------------------------------------


def _histogram_sql(parts: dict[str, str], source: str, bins: int) -> tuple[str, ...]:
    return (
        "hist_long AS ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, CAST({e} AS DOUBLE) AS v FROM {source} WHERE {e} IS NOT NULL" for name, e in parts.items()
        )
        + ")",
        "hist_limits AS (SELECT column_name, MIN(v) AS low, MAX(v) AS high FROM hist_long GROUP BY column_name)",
        f"""hist_counts AS (SELECT column_name, LEAST(CAST(FLOOR((v - low) / (high - low) * {bins}) AS BIGINT), {bins - 1}) + 1 AS bin, COUNT(*) AS count
            FROM hist_long JOIN hist_limits USING (column_name) GROUP BY 1, 2)""",
        f"""hist AS (SELECT column_name, {n('bin')} AS bin, {r(f'low + (high - low) / {bins} * (bin - 1)')} AS bin_low,
            {r(f'low + (high - low) / {bins} * bin')} AS bin_high, COALESCE(count, 0) AS count
            FROM (SELECT column_name, low, high, unnest(range(1, {bins + 1})) AS bin FROM hist_limits)
            LEFT JOIN hist_counts USING (column_name, bin))""",
    )


_PLOTTED = ["loan_amnt", "annual_inc", "dti", "open_acc"]


@query("k1_histograms", check("SELECT * FROM hist", *_histogram_sql({c: c for c in _PLOTTED}, "clean", 40)))
def k1_histograms(spark, sf_dir):
    return rounded(figures.histogram(clean_loans(raw_loans(spark, sf_dir)), _PLOTTED))


_LOGGED = {e: x for c in ("loan_amnt", "annual_inc") for e, x in ((c, c), (f"log1p_{c}", f"ln(1 + {c})"))}


@query("k2_log_histograms", check("SELECT * FROM hist", *_histogram_sql(_LOGGED, "clean", 40)))
def k2_log_histograms(spark, sf_dir):
    return rounded(figures.log_histograms(clean_loans(raw_loans(spark, sf_dir)), ["loan_amnt", "annual_inc"]))


@query(
    "k3_calibration_curve",
    check(
        "SELECT dataset_name, bin_order, predicted_probability_mean, observed_default_rate FROM curve",
        _BAND_SOURCE,
        *calibration_sql("curve", "scored", "dataset_name", merge=False),
    ),
)
def k3_calibration_curve(spark, sf_dir):
    labelled = stored_scores(spark, sf_dir)
    return rounded(figures.calibration_curve(labelled, "target_default", "score", ["dataset_name"]))


@query(
    "k4_confusion_matrix",
    check(
        """SELECT CAST(a.v AS BIGINT) AS actual_label, CAST(b.v AS BIGINT) AS predicted_label,
           COUNT(*) FILTER (WHERE y = a.v AND CAST(p >= 0.5 AS INT) = b.v) AS loan_count
           FROM models, (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v) WHERE model_name = 'score' AND dataset_name = 'test' GROUP BY ALL""",
        MODELS_SQL,
    ),
)
def k4_confusion_matrix(spark, sf_dir):
    both = two_models(spark, sf_dir)
    return evaluation.confusion_matrix(both.filter((F.col("model_name") == "score") & (F.col("dataset_name") == "test")))


@query(
    "k5_outcome_by_model",
    check(
        """SELECT outcome_type, MAX(total_loan_amnt) FILTER (WHERE model_name = 'score') AS score,
           MAX(total_loan_amnt) FILTER (WHERE model_name = 'mirror') AS mirror FROM outcomes WHERE dataset_name = 'test' GROUP BY outcome_type""",
        *OUTCOMES_SQL,
    ),
)
def k5_outcome_by_model(spark, sf_dir):
    return rounded(figures.outcome_by_model(outcome_table(spark, sf_dir), ["score", "mirror"]), 4)


_CURVES_SQL = (MODELS_SQL, *roc_sql("kc", "models", "model_name, dataset_name"))


@query(
    "k6_model_rocs",
    check(
        f"""SELECT model_name, dataset_name, {r('false_positive_rate')} AS false_positive_rate, {r('true_positive_rate')} AS true_positive_rate,
            threshold, {r('auc')} AS auc FROM kc_points JOIN kc_auc USING (model_name, dataset_name) WHERE dataset_name = 'test'""",
        *_CURVES_SQL,
    ),
)
def k6_model_rocs(spark, sf_dir):
    test = two_models(spark, sf_dir).filter(F.col("dataset_name") == "test")
    points = evaluation.roc_points(test, score="predicted_probability", by=["model_name", "dataset_name"])
    return points.withColumns({c: F.round(c, 6) for c in ("false_positive_rate", "true_positive_rate", "auc")})


_BY_YEAR = """SELECT split AS dataset_split, issue_year, COUNT(*) AS issued_count,
    ROUND(AVG(target_default) FILTER (WHERE target_default IS NOT NULL) * 100, 2) AS default_rate_percent
    FROM (SELECT clean.split, clean.issue_year, m.target_default FROM clean LEFT JOIN m USING (split, row_id)) GROUP BY ALL"""


@query("k7_portfolio_series", check(_BY_YEAR))
def k7_portfolio_series(spark, sf_dir):
    clean = clean_loans(raw_loans(spark, sf_dir))
    modeled = cohort.with_target(cohort.terminal(clean))
    return figures.portfolio_series(cohort.volume_by_year(clean), cohort.default_rate_by_year(modeled))


@query(
    "k8_band_labels",
    check(
        """SELECT dataset_name, band_order, format('{:.0f}%–{:.0f}%', ROUND(bin_low, 4) * 100, ROUND(bin_high, 4) * 100) AS risk_band_label,
           predicted_default_probability_mean, observed_default_rate FROM (SELECT *, bin_order AS band_order,
           predicted_probability_mean AS predicted_default_probability_mean FROM bands)""",
        *_BANDS_SQL,
    ),
)
def k8_band_labels(spark, sf_dir):
    return figures.band_labels(_bands(spark, sf_dir)).select(
        "dataset_name", "band_order", "risk_band_label", "predicted_default_probability_mean", "observed_default_rate"
    )


@query(
    "k9_policy_frontier",
    check(
        f"""SELECT system_name, policy_value, {r('acceptance_rate')} AS acceptance_rate, {r('default_rate_among_accepted')} AS default_rate_among_accepted
           FROM (SELECT 'model' AS system_name, CAST(policy_value AS VARCHAR) AS policy_value, * EXCLUDE (policy_value) FROM model_outcomes
             UNION ALL SELECT 'baseline', policy_value, * EXCLUDE (policy_value) FROM base_outcomes) WHERE dataset_name = 'test'""",
        *_PAIRS_SQL,
    ),
)
def k9_policy_frontier(spark, sf_dir):
    return rounded(figures.policy_frontier(model_sweep(spark, sf_dir), base_sweep(spark, sf_dir)))


@query(
    "k10_economic_difference",
    check(
        f"SELECT baseline_policy, {r('baseline_acceptance_rate')} AS baseline_acceptance_rate, net_value_with_opportunity_cost_diff FROM matched",
        *_MATCH_SQL,
    ),
)
def k10_economic_difference(spark, sf_dir):
    return rounded(figures.economic_difference(_matched(spark, sf_dir)))


@query(
    "k11_grade_slices",
    check(
        "SELECT split, grade, sub_grade, share FROM (UNPIVOT shares ON COLUMNS(* EXCLUDE (split, grade)) INTO NAME sub_grade VALUE share) WHERE sub_grade[1] = grade",
        PIVOT_SQL,
        SHARES_SQL,
    ),
)
def k11_grade_slices(spark, sf_dir):
    distribution = validation.subgrade_distribution(modeled_loans(raw_loans(spark, sf_dir)))
    return rounded(figures.grade_slices(validation.normalised_pivot(validation.subgrade_pivot(distribution))))


@query(
    "k12_split_pivot",
    check(
        """SELECT purpose AS category, ROUND(AVG(target_default) FILTER (WHERE split = 'train') * 100, 2) AS train,
           ROUND(AVG(target_default) FILTER (WHERE split = 'test') * 100, 2) AS test FROM m GROUP BY purpose"""
    ),
)
def k12_split_pivot(spark, sf_dir):
    rates = cohort.rate_by_category(modeled_loans(raw_loans(spark, sf_dir)), "purpose")
    return figures.split_pivot(rates, "category", "default_rate_percent")


@query(
    "k13_split_series",
    check(
        """SELECT split AS dataset_split, issue_year, ROUND(AVG(target_default) * 100, 2) AS default_rate_percent
           FROM m GROUP BY split, issue_year"""
    ),
)
def k13_split_series(spark, sf_dir):
    rates = cohort.default_rate_by_year(modeled_loans(raw_loans(spark, sf_dir)))
    return figures.split_series(rates, "issue_year", "default_rate_percent")


@query(
    "k14_roc_slice",
    check(
        f"""SELECT system_name, dataset_name, {r('false_positive_rate')} AS false_positive_rate, {r('true_positive_rate')} AS true_positive_rate,
            threshold, {r('auc')} AS auc FROM ks_points JOIN ks_auc USING (system_name, dataset_name) WHERE dataset_name = 'test'""",
        f"""systems AS (SELECT 'model' AS system_name, split AS dataset_name, target_default AS y, score AS p FROM m
            UNION ALL SELECT 'baseline_subgrade', split, target_default, CAST({_RANK} AS DOUBLE) FROM m)""",
        *roc_sql("ks", "systems", "system_name, dataset_name"),
    ),
)
def k14_roc_slice(spark, sf_dir):
    loans = scored_loans(spark, sf_dir)
    artifact = validation.roc_artifact(evaluation.model_roc(loans), evaluation.subgrade_roc(loans))
    points = figures.roc_slice(artifact)
    return points.withColumns({c: F.round(c, 6) for c in ("false_positive_rate", "true_positive_rate", "auc")})


@query(
    "k15_calibration_slice",
    check(
        """SELECT 'model' AS system_name, bin_order, predicted_probability_mean, observed_default_rate FROM curve
           WHERE dataset_name = 'test'""",
        _BAND_SOURCE,
        *calibration_sql("curve", "scored", "dataset_name"),
    ),
)
def k15_calibration_slice(spark, sf_dir):
    table = evaluation.calibration_table(evaluation.label_system(scored_loans(spark, sf_dir), "model"))
    return rounded(figures.calibration_slice(validation.calibration_artifact(table)))


@query(
    "k16_band_profile",
    check(
        """SELECT dataset_name, predicted_probability_mean AS predicted_default_probability_mean, observed_default_rate, int_rate_mean
           FROM bands""",
        *_BANDS_SQL,
    ),
)
def k16_band_profile(spark, sf_dir):
    bands = _bands(spark, sf_dir, "int_rate")
    return figures.band_profile(bands, ["observed_default_rate", "int_rate_mean"]).drop("risk_band")


@query(
    "k16_subgrade_line",
    check("SELECT split, sub_grade, default_rate FROM rates", RATES_SQL),
)
def k16_subgrade_line(spark, sf_dir):
    rates = validation.default_rate_by_subgrade(modeled_loans(raw_loans(spark, sf_dir)))
    return rounded(validation.ordered_subgrades(rates).select("split", "sub_grade", "default_rate"))
