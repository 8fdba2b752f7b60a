"""Catalogue: scores and metrics (E), validation tables (V). The view's ``score`` stands in for a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tranche.functions import formats
from tranche.functions.shape import record
from tranche.operators import evaluation, validation
from tranche.plans.loans import clean_loans, modeled_loans, raw_loans, stored_loans, test_of, train_of
from tranche.plans.registry import check, n, query, r, rounded


def scored_loans(spark, sf_dir):
    """Modeled loans with the score as default probability."""
    return modeled_loans(raw_loans(spark, sf_dir)).withColumn("predicted_default_probability", F.col("score"))


def stored_scores(spark, sf_dir, *columns):
    """Score, target and key of the modeled loans, written once for plans that fit bins first."""
    loans = stored_loans(spark, sf_dir, "split", "row_id", "target_default", "score", *columns)
    return loans.withColumns({"predicted_default_probability": F.col("score"), "dataset_name": F.col("split")})


def two_models(spark, sf_dir):
    """The score and its mirror image as two scored models: one pass, one row per loan and model."""
    probabilities = F.array(
        record(model_name="score", p=F.col("score")), record(model_name="mirror", p=F.round(1 - F.col("score"), 4))
    )
    both = modeled_loans(raw_loans(spark, sf_dir)).select(
        "row_id", "target_default", "loan_amnt", F.col("split").alias("dataset_name"), F.inline(probabilities)
    )
    return evaluation.with_predictions(both, "p")


MODELS_SQL = """models AS (
    SELECT 'score' AS model_name, split AS dataset_name, row_id, target_default AS y, score AS p, loan_amnt FROM m
    UNION ALL SELECT 'mirror', split, row_id, target_default, ROUND(1 - score, 4), loan_amnt FROM m)"""


def roc_sql(name: str, source: str, keys: str) -> tuple[str, str, str, str]:
    """Points, collinear drop and trapezoid area with plain windows."""
    return (
        f"""{name}_g AS (SELECT {keys}, p AS threshold, SUM(y) AS pos, SUM(1 - y) AS neg FROM {source} GROUP BY {keys}, p)""",
        f"""{name}_w AS (SELECT *, SUM(pos) OVER (PARTITION BY {keys} ORDER BY threshold DESC) AS tp,
            SUM(neg) OVER (PARTITION BY {keys} ORDER BY threshold DESC) AS fp,
            SUM(pos) OVER (PARTITION BY {keys}) AS all_pos, SUM(neg) OVER (PARTITION BY {keys}) AS all_neg,
            LEAD(pos) OVER (PARTITION BY {keys} ORDER BY threshold DESC) AS next_pos,
            LEAD(neg) OVER (PARTITION BY {keys} ORDER BY threshold DESC) AS next_neg,
            ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY threshold DESC) AS place FROM {name}_g)""",
        f"""{name}_auc AS (SELECT {keys}, SUM(neg * (tp - pos / 2.0)) / MAX(all_pos) / MAX(all_neg) AS auc FROM {name}_w GROUP BY {keys})""",
        f"""{name}_points AS (
            SELECT {keys}, CAST(fp AS DOUBLE) / all_neg AS false_positive_rate, CAST(tp AS DOUBLE) / all_pos AS true_positive_rate,
              CAST(threshold AS DOUBLE) AS threshold
            FROM {name}_w WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
            UNION ALL SELECT {keys}, 0.0, 0.0, CAST('Infinity' AS DOUBLE) FROM {name}_auc)""",
    )


_METRICS_SQL = (
    MODELS_SQL,
    *roc_sql("mr", "models", "model_name, dataset_name"),
    """cells AS (SELECT model_name, dataset_name, AVG(POWER(p - y, 2)) AS brier_score,
        COUNT(*) FILTER (WHERE y = 0 AND p < 0.5) AS true_negative, COUNT(*) FILTER (WHERE y = 0 AND p >= 0.5) AS false_positive,
        COUNT(*) FILTER (WHERE y = 1 AND p < 0.5) AS false_negative, COUNT(*) FILTER (WHERE y = 1 AND p >= 0.5) AS true_positive
        FROM models GROUP BY model_name, dataset_name)""",
    f"""metrics AS (SELECT model_name, dataset_name, {r('auc')} AS roc_auc,
        {r('(true_positive + true_negative) / (true_positive + true_negative + false_positive + false_negative)')} AS accuracy,
        {r('true_positive / (true_positive + false_positive)')} AS precision,
        {r('true_positive / (true_positive + false_negative)')} AS recall,
        {r('2 * true_positive / (2 * true_positive + false_positive + false_negative)')} AS f1,
        {r('brier_score')} AS brier_score, true_negative, false_positive, false_negative, true_positive
        FROM cells JOIN mr_auc USING (model_name, dataset_name))""",
)
_OUTCOME = """CASE WHEN y = 1 AND p >= 0.5 THEN 'true_positive' WHEN y = 0 AND p < 0.5 THEN 'true_negative'
    WHEN y = 0 THEN 'false_positive' ELSE 'false_negative' END"""
OUTCOMES_SQL = (
    MODELS_SQL,
    f"""outcomes AS (SELECT model_name, dataset_name, {_OUTCOME} AS outcome_type, COUNT(*) AS row_count,
        {r('SUM(loan_amnt)', 4)} AS total_loan_amnt, {r('AVG(loan_amnt)', 4)} AS average_loan_amnt,
        {r('MEDIAN(loan_amnt)', 4)} AS median_loan_amnt FROM models GROUP BY ALL)""",
)


@query(
    "e1_predictions",
    check("SELECT split, row_id, score AS predicted_probability, CAST(score >= 0.5 AS BIGINT) AS predicted_label FROM m"),
)
def e1_predictions(spark, sf_dir):
    scored = evaluation.with_predictions(scored_loans(spark, sf_dir), "predicted_default_probability")
    return scored.select("split", "row_id", "predicted_probability", "predicted_label")


@query("e2_classification_metrics", check("SELECT * FROM metrics", *_METRICS_SQL))
def e2_classification_metrics(spark, sf_dir):
    return rounded(evaluation.classification_metrics(two_models(spark, sf_dir)))


@query("e3_combined_metrics", check("SELECT * FROM metrics", *_METRICS_SQL))
def e3_combined_metrics(spark, sf_dir):
    both = two_models(spark, sf_dir)
    parts = [both.filter(F.col("model_name") == name) for name in ("score", "mirror")]
    return rounded(evaluation.combine([evaluation.classification_metrics(p) for p in parts]))


@query(
    "e4_row_outcomes",
    check(
        f"""SELECT row_id, model_name, dataset_name, y AS actual_label, CAST(p >= 0.5 AS BIGINT) AS predicted_label, p AS predicted_probability,
            loan_amnt, {_OUTCOME} AS outcome_type FROM models""",
        MODELS_SQL,
    ),
)
def e4_row_outcomes(spark, sf_dir):
    return evaluation.row_outcomes(two_models(spark, sf_dir), keep=["row_id"])


def outcome_table(spark, sf_dir):
    return evaluation.outcome_summary(evaluation.row_outcomes(two_models(spark, sf_dir)))


@query("e5_outcome_summary", check("SELECT * FROM outcomes", *OUTCOMES_SQL))
def e5_outcome_summary(spark, sf_dir):
    return rounded(outcome_table(spark, sf_dir), 4)


@query(
    "e6_outcome_comparison",
    check(
        """SELECT model_name, dataset_name, outcome_type, row_count,
           format('${:,}', CAST(ROUND(total_loan_amnt) AS BIGINT)) AS total_loan_amnt
           FROM outcomes WHERE dataset_name = 'test'""",
        *OUTCOMES_SQL,
    ),
)
def e6_outcome_comparison(spark, sf_dir):
    compared = outcome_table(spark, sf_dir).filter(F.col("dataset_name") == "test")
    return compared.select(
        "model_name", "dataset_name", "outcome_type", "row_count",
        formats.money(F.round("total_loan_amnt", 2)).alias("total_loan_amnt"),
    )


@query(
    "m7_selection_record",
    check(
        """SELECT metrics.*, fn.total_loan_amnt AS false_negative_exposure, fp.total_loan_amnt AS false_positive_exposure
           FROM metrics JOIN outcomes fn ON fn.model_name = metrics.model_name AND fn.dataset_name = metrics.dataset_name AND fn.outcome_type = 'false_negative'
           JOIN outcomes fp ON fp.model_name = metrics.model_name AND fp.dataset_name = metrics.dataset_name AND fp.outcome_type = 'false_positive'
           WHERE metrics.model_name = 'score' AND metrics.dataset_name = 'test'""",
        *_METRICS_SQL,
        OUTCOMES_SQL[1],
    ),
)
def m7_selection_record(spark, sf_dir):
    both = two_models(spark, sf_dir)
    outcomes = evaluation.outcome_summary(evaluation.row_outcomes(both))
    chosen = evaluation.selection_record(evaluation.classification_metrics(both), outcomes, "score")
    money = ["false_negative_exposure", "false_positive_exposure"]
    return rounded(chosen.withColumns({c: F.round(c, 4) for c in money}))


# --- validation -----------------------------------------------------------------------------


@query("v1_align_clean_rows", check("SELECT split, row_id, loan_status, target_default FROM m"))
def v1_align_clean_rows(spark, sf_dir):
    loans = raw_loans(spark, sf_dir)
    aligned = validation.align_clean_rows(clean_loans(loans), modeled_loans(loans))
    return aligned.select("split", "row_id", "loan_status", "target_default")


@query(
    "v1_alignment_contracts",
    check(
        """SELECT contract, CAST(SUM(v) AS BIGINT) AS violations FROM (
             SELECT 'unique_key(split,row_id)' AS contract, COUNT(*) AS v FROM (SELECT split, row_id FROM clean GROUP BY ALL HAVING COUNT(*) > 1)
             UNION ALL SELECT 'keys_missing_on_right', COUNT(*) FROM m ANTI JOIN clean USING (split, row_id)
             UNION ALL SELECT 'keys_missing_on_left', COUNT(*) FROM clean ANTI JOIN m USING (split, row_id)
           ) GROUP BY contract UNION ALL SELECT 'unique_key(split,row_id)', COUNT(*) FROM (SELECT split, row_id FROM m GROUP BY ALL HAVING COUNT(*) > 1)"""
    ),
)
def v1_alignment_contracts(spark, sf_dir):
    loans = raw_loans(spark, sf_dir)
    return validation.alignment_contracts(clean_loans(loans), modeled_loans(loans))


@query(
    "v3_grade_structure",
    check(
        f"""SELECT split, grade, COUNT(*) AS loan_count, COUNT(DISTINCT sub_grade) AS distinct_subgrades,
            COUNT(*) - COUNT(sub_grade) AS missing_subgrade_count, {r('(COUNT(*) - COUNT(sub_grade)) / COUNT(*)')} AS missing_subgrade_rate
            FROM m GROUP BY split, grade"""
    ),
)
def v3_grade_structure(spark, sf_dir):
    return rounded(validation.grade_structure(modeled_loans(raw_loans(spark, sf_dir))))


@query(
    "v3_subgrade_distribution",
    check("SELECT split, grade, sub_grade, COUNT(*) AS loan_count FROM m GROUP BY split, grade, sub_grade"),
)
def v3_subgrade_distribution(spark, sf_dir):
    return validation.subgrade_distribution(modeled_loans(raw_loans(spark, sf_dir)))


RATES_SQL = f"""rates AS (SELECT split, sub_grade, COUNT(*) AS loan_count, {n('SUM(target_default)')} AS default_count,
    {n('SUM(1 - target_default)')} AS non_default_count, {r('AVG(target_default)')} AS default_rate FROM m GROUP BY split, sub_grade)"""


@query("v4_default_rate_by_subgrade", check("SELECT * FROM rates", RATES_SQL))
def v4_default_rate_by_subgrade(spark, sf_dir):
    return rounded(validation.default_rate_by_subgrade(modeled_loans(raw_loans(spark, sf_dir))))


_RANK = "((ASCII(sub_grade) - ASCII('a')) * 5 + CAST(sub_grade[2] AS INT))"


@query("v5_subgrade_rank", check(f"SELECT split, row_id, CAST({_RANK} AS INT) AS subgrade_rank FROM m"))
def v5_subgrade_rank(spark, sf_dir):
    ranked = evaluation.with_subgrade_rank(modeled_loans(raw_loans(spark, sf_dir)))
    return ranked.select("split", "row_id", "subgrade_rank")


_SYSTEMS_SQL = f"""systems AS (
    SELECT 'model' AS system_name, split AS dataset_name, target_default AS y, score AS p FROM m
    UNION ALL SELECT 'baseline_subgrade', split, target_default, CAST({_RANK} AS DOUBLE) FROM m)"""
_ROC_SQL = (_SYSTEMS_SQL, *roc_sql("rc", "systems", "system_name, dataset_name"))
_ROC_SELECT = f"""SELECT system_name, dataset_name, {r('false_positive_rate')} AS false_positive_rate,
    {r('true_positive_rate')} AS true_positive_rate, threshold, {r('auc')} AS auc
    FROM rc_points JOIN rc_auc USING (system_name, dataset_name)"""


def _roc_rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("false_positive_rate", "true_positive_rate", "auc")})


@query("v6_model_roc", check(_ROC_SELECT + " WHERE system_name = 'model'", *_ROC_SQL))
def v6_model_roc(spark, sf_dir):
    return _roc_rounded(evaluation.model_roc(scored_loans(spark, sf_dir)))


@query("v7_subgrade_roc", check(_ROC_SELECT + " WHERE system_name = 'baseline_subgrade'", *_ROC_SQL))
def v7_subgrade_roc(spark, sf_dir):
    return _roc_rounded(evaluation.subgrade_roc(modeled_loans(raw_loans(spark, sf_dir))))


@query(
    "v8_subgrade_auc",
    check(f"SELECT system_name, dataset_name, {r('auc')} AS auc FROM rc_auc WHERE system_name = 'baseline_subgrade'", *_ROC_SQL),
)
def v8_subgrade_auc(spark, sf_dir):
    ranked = evaluation.with_subgrade_rank(modeled_loans(raw_loans(spark, sf_dir)), output="rank")
    labelled = evaluation.label_system(ranked, "baseline_subgrade")
    return rounded(evaluation.auc(labelled, ["system_name", "dataset_name"], "target_default", "rank"))


_TENTHS = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"


def calibration_sql(table: str, source: str, keys: str, extra: str = "", merge: bool = True) -> tuple[str, ...]:
    edges = f"quantile_cont(p, {_TENTHS})"
    return (
        f"""{table}_edges AS (SELECT {keys}, {f'list_sort(list_distinct({edges}))' if merge else edges} AS edges FROM {source} GROUP BY {keys})""",
        f"""{table}_binned AS (SELECT s.*, edges, 1 + len(list_filter(edges[2:len(edges) - 1], lambda e: e < s.p)) AS bin
            FROM {source} s JOIN {table}_edges USING ({keys}))""",
        f"""{table} AS (SELECT {keys}, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY bin) AS bin_order, * EXCLUDE ({keys})
            FROM (SELECT {keys}, bin, {r('ANY_VALUE(edges)[bin]')} AS bin_low, {r('ANY_VALUE(edges)[bin + 1]')} AS bin_high, COUNT(*) AS row_count,
              {r('AVG(p)')} AS predicted_probability_mean, {r('AVG(y)')} AS observed_default_rate,
              {r('MIN(p)')} AS predicted_probability_min, {r('MAX(p)')} AS predicted_probability_max {extra}
              FROM {table}_binned GROUP BY {keys}, bin))""",
    )


_CALIBRATION_SQL = (_SYSTEMS_SQL, *calibration_sql("calib", "systems", "system_name, dataset_name"))
_MODEL_CALIBRATION = "SELECT * EXCLUDE (bin) FROM calib WHERE system_name = 'model'"


@query("v9_calibration", check(_MODEL_CALIBRATION, *_CALIBRATION_SQL))
def v9_calibration(spark, sf_dir):
    labelled = evaluation.label_system(stored_scores(spark, sf_dir), "model")
    return rounded(evaluation.calibration_table(labelled).drop("calibration_bin"))


_PIVOT = ", ".join(f"COUNT(*) FILTER (WHERE sub_grade = '{s}') AS {s}" for s in validation.SUBGRADES)
_SHARES = ", ".join(f"{r(f'{s} / total')} AS {s}" for s in validation.SUBGRADES)
PIVOT_SQL = f"pivoted AS (SELECT split, grade, {_PIVOT} FROM m GROUP BY split, grade)"
SHARES_SQL = f"shares AS (SELECT split, grade, {_SHARES} FROM (SELECT *, {' + '.join(validation.SUBGRADES)} AS total FROM pivoted))"


def _distribution(spark, sf_dir):
    return validation.subgrade_distribution(modeled_loans(raw_loans(spark, sf_dir)))


@query("v10_subgrade_pivot", check("SELECT * FROM pivoted", PIVOT_SQL))
def v10_subgrade_pivot(spark, sf_dir):
    return validation.subgrade_pivot(_distribution(spark, sf_dir))


@query("v11_normalised_pivot", check("SELECT * FROM shares", PIVOT_SQL, SHARES_SQL))
def v11_normalised_pivot(spark, sf_dir):
    return rounded(validation.normalised_pivot(validation.subgrade_pivot(_distribution(spark, sf_dir))))


@query("v12_ordered_subgrades", check("SELECT * FROM rates", RATES_SQL))
def v12_ordered_subgrades(spark, sf_dir):
    rates = validation.default_rate_by_subgrade(modeled_loans(raw_loans(spark, sf_dir)))
    return rounded(validation.ordered_subgrades(rates))


def _curves(spark, sf_dir):
    loans = scored_loans(spark, sf_dir)
    return evaluation.model_roc(loans), evaluation.subgrade_roc(loans)


_AUC_SELECT = f"SELECT system_name, dataset_name, {r('auc')} AS auc FROM rc_auc"


@query("v13_risk_separation", check(_AUC_SELECT, *_ROC_SQL))
def v13_risk_separation(spark, sf_dir):
    return rounded(validation.risk_separation(validation.roc_artifact(*_curves(spark, sf_dir))))


@query("v14_roc_artifact", check(_ROC_SELECT, *_ROC_SQL))
def v14_roc_artifact(spark, sf_dir):
    return _roc_rounded(validation.roc_artifact(*_curves(spark, sf_dir)))


@query("v15_calibration_artifact", check("SELECT * EXCLUDE (bin) FROM calib", *_CALIBRATION_SQL))
def v15_calibration_artifact(spark, sf_dir):
    loans = evaluation.with_subgrade_rank(scored_loans(spark, sf_dir))
    model = evaluation.calibration_table(evaluation.label_system(loans, "model"))
    ranked = loans.withColumn("predicted_default_probability", F.col("subgrade_rank").cast("double"))
    baseline = evaluation.calibration_table(evaluation.label_system(ranked, "baseline_subgrade"))
    return rounded(validation.calibration_artifact(model, baseline).drop("calibration_bin"))


@query(
    "v16_grade_structure_artifact",
    check("SELECT split, grade, COUNT(*) AS loan_count, COUNT(DISTINCT sub_grade) AS distinct_subgrades FROM m GROUP BY split, grade"),
)
def v16_grade_structure_artifact(spark, sf_dir):
    structure = validation.grade_structure(modeled_loans(raw_loans(spark, sf_dir)))
    stacked = validation.stack_splits(train_of(structure), test_of(structure))
    return stacked.select("split", "grade", "loan_count", "distinct_subgrades")


@query("v17_distribution_artifact", check("SELECT * FROM pivoted", PIVOT_SQL))
def v17_distribution_artifact(spark, sf_dir):
    distribution = _distribution(spark, sf_dir)
    return validation.subgrade_pivot(validation.stack_splits(train_of(distribution), test_of(distribution)))


@query("v18_default_rate_artifact", check("SELECT * FROM rates", RATES_SQL))
def v18_default_rate_artifact(spark, sf_dir):
    rates = validation.default_rate_by_subgrade(modeled_loans(raw_loans(spark, sf_dir)))
    return rounded(validation.ordered_subgrades(validation.stack_splits(train_of(rates), test_of(rates))))


@query(
    "v19_describe_rates",
    check(
        f"""SELECT split, COUNT(rate) AS count, {r('AVG(rate)')} AS mean, {r('STDDEV_SAMP(rate)')} AS std, {r('MIN(rate)')} AS min,
            {r('quantile_cont(rate, 0.25)')} AS p25, {r('quantile_cont(rate, 0.5)')} AS p50, {r('quantile_cont(rate, 0.75)')} AS p75,
            {r('MAX(rate)')} AS max FROM (SELECT split, sub_grade, AVG(target_default) AS rate FROM m GROUP BY split, sub_grade) GROUP BY split"""
    ),
)
def v19_describe_rates(spark, sf_dir):
    return rounded(validation.describe_rates(validation.default_rate_by_subgrade(modeled_loans(raw_loans(spark, sf_dir)))))


@query(
    "v20_auc_comparison",
    check(f"SELECT system_name AS system, dataset_name AS split, {r('auc')} AS auc FROM rc_auc", *_ROC_SQL),
)
def v20_auc_comparison(spark, sf_dir):
    return rounded(validation.auc_comparison(*_curves(spark, sf_dir)))
