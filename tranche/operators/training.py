"""Model fits as Spark ML jobs: logistic regression, forests, boosted trees, random search."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche import contracts
from tranche.functions.guards import require_columns
from tranche.functions.shape import local_table, record, rows_of
from tranche.operators import evaluation, ordered
from tranche.plans.session import shared_folder, written_once

# Spark's trees cannot grow deeper than this.
DEEPEST_TREE = 30
# Ranges of the random search, in the order they are drawn.
SEARCH_RANGES = {
    "iterations": (300, 801),
    "learning_rate": (0.02, 0.15),
    "depth": (4, 9),
    "l2_leaf_reg": (1.0, 10.0),
    "border_count": (32, 129),
    "random_strength": (0.5, 2.0),
}


def training_contract(df: DataFrame, features: Sequence[str], target: str, allow_null_features: bool = False) -> int:
    """Target is 0/1 with both classes, features carry no nulls; returns the row count. One pass."""
    require_columns(df, target, *features)
    y = F.col(target)
    nulls = sum((F.col(f).isNull().cast("bigint") for f in features), F.lit(0).cast("bigint"))
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(y.isin(0, 1), F.lit(False))).alias("bad_target"),
        F.count_distinct(y).alias("classes"),
        F.sum(nulls).alias("nulls"),
    ).first()
    if row.rows == 0 or row.bad_target or row.classes != 2:
        raise contracts.ContractViolation(f"target must hold 0 and 1 and no nulls: {row.asDict()}")
    if row.nulls and not allow_null_features:
        raise contracts.ContractViolation(f"features hold {row.nulls} nulls")
    return row.rows


def scaling(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_name, mean, scale): train mean and population deviation; 1 for constant features."""
    aggs, records = [], []
    for i, f in enumerate(features):
        v = F.col(f).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
        scale = F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(F.lit(1.0))
        records.append(record(feature_name=f, mean=F.col(f"m{i}"), scale=scale))
    return rows_of(train.agg(*aggs), [], records)


def standardise(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """(x - train mean) / train population deviation for every row; two numbers per feature are fitted."""
    require_columns(df, *features)
    fitted = {r.feature_name: (r["mean"], r["scale"]) for r in scaling(df.filter(F.col(split) == "train"), features).collect()}
    return df.withColumns({f: (F.col(f).cast("double") - F.lit(m)) / F.lit(s) for f, (m, s) in fitted.items()})


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def _growable(depth: int) -> int:
    if depth > DEEPEST_TREE:
        raise ValueError(f"Spark grows trees of at most {DEEPEST_TREE} levels; asked for {depth}")
    return depth


def _class_weights(train: DataFrame, target: str, class_weight: str | dict[int, float] | None) -> Column | None:
    """Row weights from class weights; "balanced" gives every class the same total."""
    if class_weight is None:
        return None
    if class_weight == "balanced":
        sizes = {r[0]: r[1] for r in train.groupBy(target).agg(F.count(F.lit(1))).collect()}
        class_weight = {c: sum(sizes.values()) / (len(sizes) * n) for c, n in sizes.items()}
    if not isinstance(class_weight, dict) or not {0, 1} <= set(class_weight):
        raise ValueError('class_weight must be "balanced" or hold a weight for 0 and for 1')
    return F.when(F.col(target) == 1, F.lit(float(class_weight[1]))).otherwise(F.lit(float(class_weight[0])))


def _without_summary(model: PipelineModel, train: DataFrame) -> PipelineModel:
    """The fitted model as it is saved. The summary that a fit leaves in a model holds the session, which can't be sent to
    tasks once an observation was made in it; scoring sends the model.
    """
    path = shared_folder(train.sparkSession, "fit")
    model.save(path)
    return PipelineModel.load(path)


def logistic_regression(
    train: DataFrame,
    features: Sequence[str],
    target: str = "target_default",
    max_iter: int = 1000,
    inverse_penalty: float = 1.0,
    weight: str | None = None,
    class_weight: str | dict[int, float] | None = None,
) -> tuple[PipelineModel, dict]:
    """L2 logistic regression with the penalty given as C; returns the model and how the fit went.

    Spark averages the loss over rows, so C on the summed loss is a penalty of 1 / (C n).
    """
    if weight and class_weight:
        raise ValueError("give either row weights or class weights")
    rows = training_contract(train, features, target)
    weights = _class_weights(train, target, class_weight)
    if weights is not None:
        train, weight = train.withColumn("_weight", weights), "_weight"
    estimator = LogisticRegression(
        labelCol=target,
        maxIter=max_iter,
        regParam=1.0 / (inverse_penalty * rows),
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-6,
    )
    if weight:
        estimator = estimator.setWeightCol(weight)
    model = Pipeline(stages=[_assembler(features), estimator]).fit(train)
    used = model.stages[-1].summary.totalIterations
    return _without_summary(model, train), {"rows": rows, "iterations": used, "max_iter": max_iter, "converged": used < max_iter}


def random_forest(
    train: DataFrame,
    features: Sequence[str],
    target: str = "target_default",
    trees: int = 300,
    max_depth: int | None = None,
    min_leaf: int = 1,
    max_features: str = "sqrt",
    min_split: int = 2,
    class_weight: str | dict[int, float] | None = None,
    seed: int = 42,
) -> tuple[PipelineModel, dict]:
    """Forest on ``max_features`` per split; ``max_depth=None`` means as deep as Spark allows.

    Spark's trees split any node that leaves ``min_leaf`` rows on both sides: a larger ``min_split`` is refused.
    """
    if min_split > max(2, 2 * min_leaf):
        raise ValueError("min_split has no counterpart beyond what min_leaf implies")
    if max_features not in ("sqrt", "log2", "all", "onethird") and not max_features.replace(".", "", 1).isdigit():
        raise ValueError(f"max_features is not known to Spark: {max_features}")
    rows = training_contract(train, features, target)
    depth = DEEPEST_TREE if max_depth is None else _growable(max_depth)
    weights = _class_weights(train, target, class_weight)
    estimator = RandomForestClassifier(
        labelCol=target,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy=max_features,
        seed=seed,
    )
    if weights is not None:
        train, estimator = train.withColumn("_weight", weights), estimator.setWeightCol("_weight")
    model = Pipeline(stages=[_assembler(features), estimator]).fit(train)
    return _without_summary(model, train), {"rows": rows, "trees": trees, "max_depth": depth, "seed": seed}


def boosted_trees(
    train: DataFrame,
    features: Sequence[str],
    target: str = "target_default",
    categorical: Sequence[str] = (),
    weight: str | None = None,
    iterations: int = 500,
    learning_rate: float = 0.05,
    depth: int = 6,
    max_bins: int = 254,
    seed: int = 42,
) -> tuple[PipelineModel, dict]:
    """Gradient-boosted trees on the logistic loss. Categorical features are indexed, unseen values kept.

    Leaf regularisation and split noise have no counterpart in Spark ML.
    """
    categorical = list(categorical)
    missing = [c for c in categorical if c not in features]
    if missing or len(set(categorical)) != len(categorical):
        raise ValueError(f"categorical features must be distinct features: {missing or categorical}")
    plain = [f for f in features if f not in categorical]
    rows = training_contract(train, plain, target)
    stages: list = []
    inputs = list(plain)
    bins = max_bins
    if categorical:
        indexer = StringIndexer(
            inputCols=categorical, outputCols=[f"{c}_index" for c in categorical], handleInvalid="keep"
        ).fit(train)
        # One bin per category and one for unseen values.
        bins = max([max_bins, *[len(labels) + 1 for labels in indexer.labelsArray]])
        stages.append(indexer)
        inputs += [f"{c}_index" for c in categorical]
    estimator = GBTClassifier(
        labelCol=target,
        maxIter=iterations,
        stepSize=learning_rate,
        maxDepth=_growable(depth),
        maxBins=max(2, bins),
        lossType="logistic",
        seed=seed,
    )
    if weight:
        estimator = estimator.setWeightCol(weight)
    model = Pipeline(stages=[*stages, _assembler(inputs), estimator]).fit(train)
    params = {"iterations": iterations, "learning_rate": learning_rate, "depth": depth, "max_bins": bins, "seed": seed}
    return model, {"rows": rows, "weighted": weight is not None, "categorical": categorical, "model_params": params}


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5, model_name: str | None = None, split: str = "split") -> DataFrame:
    """P(class 1) and the label p >= threshold beside the input columns."""
    scored = model.transform(df).withColumn("_p1", vector_to_array("probability")[1])
    result = evaluation.with_predictions(scored, "_p1", threshold).select(
        *df.columns, "predicted_probability", "predicted_label"
    )
    if model_name is None:
        return result
    return result.withColumns({"model_name": F.lit(model_name), "dataset_name": F.col(split)})


def stratified_holdout(
    df: DataFrame, key: Sequence[str], target: str = "target_default", share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_holdout``: exactly round(share x class size) rows of every class, the same for a seed.

    Rows are ordered by a seeded hash of their key. Only the hash at the cut of each class is looked
    up, range by range, so no task orders a whole class.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    require_columns(df, target, *key)
    place = F.struct(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)).alias("hash"), *key)
    counts = df.groupBy(F.col(target).alias("_class"), place.alias("_place")).agg(F.count(F.lit(1)).alias("n"))
    cuts = ordered.select_ranks(
        counts,
        ["_class"],
        "_place",
        lambda size: F.array(record(tag=F.lit("cut"), rank=(F.round(size * share) - 1).cast("bigint"))),
    ).select("_class", F.col("_place").alias("_cut"))
    # One row per class.
    return (
        df.join(F.broadcast(cuts), df[target] == cuts["_class"], "left")
        .withColumn("is_holdout", F.coalesce(place <= F.col("_cut"), F.lit(False)))
        .drop("_class", "_cut")
    )


def draw_trials(trials: int, seed: int = 42, ranges: dict[str, tuple] | None = None) -> list[dict]:
    """Seeded random-search settings from ``ranges``: whole numbers below the upper end, or any between the ends."""
    ranges = SEARCH_RANGES | (ranges or {})
    if set(ranges) != set(SEARCH_RANGES):
        raise ValueError(f"unknown settings: {sorted(set(ranges) - set(SEARCH_RANGES))}")
    rng = np.random.default_rng(seed)
    draws = []
    for _ in range(trials):
        setting = {}
        for name, (low, high) in ranges.items():
            whole = isinstance(low, int)
            setting[name] = int(rng.integers(low, high)) if whole else float(rng.uniform(low, high))
        draws.append(setting)
    return draws


def random_search(
    train: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    target: str = "target_default",
    categorical: Sequence[str] = (),
    weight: str | None = None,
    trials: int = 25,
    holdout_share: float = 0.2,
    seed: int = 42,
    parallelism: int = 2,
    ranges: dict[str, tuple] | None = None,
    booster: str = "spark",
) -> tuple[dict, DataFrame]:
    """Fit every trial on 80 %, rank by exact AUC on the stratified rest: (best setting, results).

    Trials are independent Spark jobs and may overlap. ``ranges`` replaces ranges that settings are drawn from.
    ``booster="spark"`` fits Spark ML's trees, which take iterations, learning rate, depth and border count;
    ``"histogram"`` fits symmetric histogram trees that take all six settings, leaf penalty and split noise too. Its
    trials are fitted and scored together, on the same binned rows.
    """
    if trials <= 0:
        raise ValueError("trials must be positive")
    if booster not in ("spark", "histogram") or (booster == "histogram" and categorical):
        raise ValueError("booster is 'spark' or 'histogram'; histogram trees take numeric features only")
    parts = stratified_holdout(train, key, target, holdout_share, seed).persist()
    fit_rows, check_rows = parts.filter(~F.col("is_holdout")), parts.filter("is_holdout")
    settings = draw_trials(trials, seed, ranges)

    def run(number_and_setting):
        number, setting = number_and_setting
        model, _ = boosted_trees(
            fit_rows, features, target, categorical, weight, setting["iterations"],
            setting["learning_rate"], setting["depth"], setting["border_count"], seed,
        )
        scored = score(model, check_rows).withColumn("_trial", F.lit(number))
        return evaluation.auc(scored, ["_trial"], target, "predicted_probability").first()["auc"]

    try:
        if booster == "histogram":
            from tranche.operators import histogram_boosting

            forests = histogram_boosting.fit_many(fit_rows, features, settings, target, weight, seed)
            scored = histogram_boosting.predict_many(forests, check_rows.select(target, *features), "_trial")
            scored = written_once(scored.select("_trial", target, "predicted_probability"), "scored")
            found = {r["_trial"]: r["auc"] for r in evaluation.auc(scored, ["_trial"], target, "predicted_probability").collect()}
            areas = [found[number] for number in range(trials)]
        else:
            with ThreadPoolExecutor(max_workers=parallelism) as pool:
                areas = list(pool.map(run, enumerate(settings)))
    finally:
        parts.unpersist()
    results = [{"trial_index": number, "roc_auc": area, **setting} for number, (area, setting) in enumerate(zip(areas, settings, strict=True))]
    best = max(results, key=lambda r: (r["roc_auc"], -r["trial_index"]))
    schema = (
        "trial_index bigint, roc_auc double, iterations bigint, learning_rate double, depth bigint, "
        "l2_leaf_reg double, border_count bigint, random_strength double"
    )
    table = local_table(train.sparkSession, results, schema)
    chosen = {n: best[n] for n in SEARCH_RANGES}
    return chosen, table.orderBy(F.desc("roc_auc"), "trial_index")
