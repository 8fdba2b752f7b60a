"""Gradient boosting with a leaf penalty and split noise: symmetric trees grown from histogram sums.

Every feature is cut into bins at train quantiles (``border_count`` at most); a null or NaN value has a bin of its own,
the last. A tree is symmetric: each level splits all its leaves by one (feature, border), chosen from weighted gradient
and hessian sums per (leaf so far, feature, bin) of the logistic loss. From these sums alone every candidate is scored by
the penalised gain ``sum over leaves of GL^2/(HL + l2) + GR^2/(HR + l2) - G^2/(H + l2)``; with ``random_strength`` above
zero a seeded normal noise of ``random_strength`` times the standard deviation of the level's candidate gains is added
before the best is taken. Leaf values are Newton steps ``-G / (H + l2)`` times the learning rate.

Binned rows are written once to the shared folder, as blocks of ``BLOCK_ROWS`` rows. Many forests are fitted on the same
blocks (``fit_many``), which hold bins between the borders of all of them; a forest looks its own bins up from those.

- Up to ``MOST_IN_A_TASK`` values, a forest is grown by one task from a broadcast of the blocks, forests beside each other.
- With more, all forests grow level by level together: a level is one Spark job over the blocks, whose tasks each send
  the sums of all forests, at most ``2**depth * features * (border_count + 2)`` pairs a forest, a bound set by the
  parameters and never by the rows; many tasks add theirs up in a tree first. Blocks are persisted with each forest's
  row scores, which take in the new trees every ``checkpoint_every`` trees; a level adds the trees since then by itself.

Both give the same trees: sums are exact (``symmetric_trees``).

Nulls: null features fall in the null bin; a null weight counts as 0; rows with a null target are refused by the
contract. A feature that is constant has no border and never splits. A leaf without hessian and penalty (empty, or
l2 of 0 with no rows) has the value 0 and adds nothing to a gain. Ties between candidates go to the lower feature
position, then the lower bin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranche.operators import symmetric_trees
from tranche.operators.training import training_contract
from tranche.plans.session import written_once

# Rows of a block, and values (rows x features) of a fit that one task may hold: a task needs about 5 bytes a value.
BLOCK_ROWS = 1 << 16
MOST_IN_A_TASK = 1 << 24
# More partial sums than these are added up by tasks before they come to the driver.
MOST_PARTIALS = 16
# Scores follow from the written blocks by fewer steps than these.
MOST_STEPS = 10


@dataclass
class Forest:
    """Borders per feature, the base score and the trees: per tree its levels' (feature position, split bin) and leaf values."""

    features: list[str]
    borders: list[list[float]]
    base: float
    trees: list[tuple[list[tuple[int, int]], list[float]]] = field(default_factory=list)
    gains: list[list[float]] = field(default_factory=list)


def binned(col: Column, borders: Sequence[float]) -> Column:
    """Bin of a value: the number of (ascending) borders below it; null and NaN take the bin after the last.

    The borders are halved: a step goes forward where the border it reaches is below the value.
    """
    x = col.cast("double")
    if not borders:
        count = F.lit(0)
    else:
        # One literal: thousands of them make a plan that fills the driver.
        ascending = F.split(F.lit(",".join(repr(float(b)) for b in borders)), ",").cast("array<double>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
        # A step beyond the last border reaches null and is not taken.
        count = F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(x > F.get(ascending, n + s - 1), s).otherwise(0))
    return F.when(x.isNull() | F.isnan(x), F.lit(len(borders) + 1)).otherwise(count)


def fit(
    train: DataFrame,
    features: Sequence[str],
    target: str = "target_default",
    weight: str | None = None,
    iterations: int = 500,
    learning_rate: float = 0.05,
    depth: int = 6,
    l2_leaf_reg: float = 3.0,
    random_strength: float = 1.0,
    border_count: int = 128,
    seed: int = 42,
    checkpoint_every: int = 10,
) -> Forest:
    """Fit symmetric trees on the logistic loss."""
    setting = {
        "iterations": iterations, "learning_rate": learning_rate, "depth": depth,
        "l2_leaf_reg": l2_leaf_reg, "random_strength": random_strength, "border_count": border_count,
    }
    return fit_many(train, features, [setting], target, weight, seed, checkpoint_every)[0]


def fit_many(
    train: DataFrame,
    features: Sequence[str],
    settings: Sequence[dict],
    target: str = "target_default",
    weight: str | None = None,
    seed: int = 42,
    checkpoint_every: int = 10,
    most_in_a_task: int = MOST_IN_A_TASK,
) -> list[Forest]:
    """A forest for each setting (the arguments of ``fit`` from ``iterations`` to ``border_count``), all on the same rows."""
    features = list(features)
    if any(s["depth"] < 1 or s["iterations"] < 0 or s["border_count"] < 2 for s in settings):
        raise ValueError("depth and border_count must be positive, iterations not negative")
    rows_in = training_contract(train, features, target, allow_null_features=True)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    xs = [f"x{j}" for j in range(len(features))]
    numeric = train.select(*[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)], F.col(target).cast("double").alias("y"), w.alias("w"))
    # Quantiles, totals and bins are taken from the same written values.
    numeric = written_once(numeric, "boosting")
    borders = _borders(numeric, xs, sorted({s["border_count"] for s in settings}))
    totals = numeric.agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("ws"), F.sum(F.abs("w")).alias("size")).first()
    mean = min(max((totals.wy or 0.0) / totals.ws, 1e-12), 1 - 1e-12) if totals.ws else 0.5
    base, step = float(np.log(mean / (1 - mean))), symmetric_trees.exact_step(totals.size)
    forests = [Forest(features, borders[s["border_count"]], base) for s in settings]
    fine = _joint(forests)
    growths = [symmetric_trees.Growth(dict(s), max([len(b) for b in f.borders], default=0) + 2, seed) for s, f in zip(settings, forests)]
    blocks = _blocks(numeric, xs, fine)
    lookups = [_lookups(f, fine) for f in forests]
    if rows_in * len(features) <= most_in_a_task:
        growths = _grown_in_tasks(blocks, growths, lookups, base, step)
    else:
        _grow_by_levels(blocks, growths, lookups, base, step, checkpoint_every)
    for forest, growth in zip(forests, growths):
        forest.trees, forest.gains = growth.trees, growth.gains
    return forests


def _borders(numeric: DataFrame, xs: Sequence[str], counts: Sequence[int]) -> dict[int, list[list[float]]]:
    """Distinct quantiles of every column for each border count, from one pass as exact as the largest count needs."""
    shares = {n: [k / n for k in range(1, n)] for n in counts}
    wanted = sorted({p for of in shares.values() for p in of})
    found = [dict(zip(wanted, c)) for c in numeric.stat.approxQuantile(list(xs), wanted, 1.0 / (4 * max(counts)))]
    # A column without values has no quantiles.
    return {n: [sorted({c[p] for p in of if p in c}) for c in found] for n, of in shares.items()}


def _joint(forests: Sequence[Forest]) -> list[list[float]]:
    """The borders that any of the forests has, per feature."""
    return [sorted(set().union(*of)) for of in zip(*(f.borders for f in forests))]


def _lookups(forest: Forest, fine: Sequence[Sequence[float]]) -> list[np.ndarray]:
    """Per feature: the forest's bin of every bin between the joint borders."""
    kind = symmetric_trees.narrow(max(len(b) for b in forest.borders) + 1)
    out = []
    for own, joint in zip(forest.borders, fine):
        places = np.searchsorted(joint, own)
        # Beyond k joint borders are those of its own among the first k; the null bin comes last.
        out.append(np.append(np.searchsorted(places, np.arange(len(joint) + 1)), len(own) + 1).astype(kind))
    return out


def _own(bins: np.ndarray, lookups: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([at[b] for at, b in zip(lookups, bins)])


def _blocks(numeric: DataFrame, xs: Sequence[str], fine: Sequence[Sequence[float]]) -> DataFrame:
    """(bins, y, w): blocks of rows as packed arrays, bins feature by feature; written once."""
    kind = symmetric_trees.narrow(max(len(b) for b in fine) + 1)
    binary = pa.schema([(c, pa.binary()) for c in ("bins", "y", "w")])

    def packed(table: pa.Table) -> pa.RecordBatch:
        columns = [c.to_numpy() for c in table.columns]
        bins = np.stack([c.astype(kind) for c in columns[:-2]])
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (bins, *columns[-2:])], schema=binary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield packed(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield packed(pa.Table.from_batches(held))

    rows = numeric.select(*[binned(F.col(x), b).alias(x) for x, b in zip(xs, fine)], "y", "w")
    made = rows.mapInArrow(pack, "bins binary, y binary, w binary")
    return written_once(made.repartition(numeric.sparkSession.sparkContext.defaultParallelism), "boosting")


def _arrays(row, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, w = np.frombuffer(row.y), np.frombuffer(row.w)
    kind = np.dtype(f"u{len(row.bins) // (features * len(y))}")
    return np.frombuffer(row.bins, kind).reshape(features, len(y)), y, w


def _grown_in_tasks(blocks: DataFrame, growths: Sequence[symmetric_trees.Growth], lookups: Sequence, base: float, step: float) -> list[symmetric_trees.Growth]:
    """Every forest grown by one task; those with most levels start first."""
    context = blocks.sparkSession.sparkContext
    parts = [_arrays(r, len(lookups[0])) for r in blocks.collect()]  # at most MOST_IN_A_TASK values
    held = context.broadcast((np.concatenate([b for b, _, _ in parts], axis=1), *[np.concatenate(p) for p in list(zip(*parts))[1:]], list(lookups)))

    def grown(number_and_growth):
        number, growth = number_and_growth
        bins, y, w, every = held.value
        return number, symmetric_trees.grown_here(growth, _own(bins, every[number]), y, w, base, step)

    cost = lambda at: -at[1].setting["iterations"] * at[1].setting["depth"]
    try:
        out = dict(context.parallelize(sorted(enumerate(growths), key=cost), len(growths)).map(grown).collect())
    finally:
        held.destroy()
    return [out[i] for i in range(len(growths))]


def _grow_by_levels(blocks: DataFrame, growths: Sequence[symmetric_trees.Growth], lookups: Sequence, base: float, step: float, checkpoint_every: int) -> None:
    """All forests together, one job a level over the blocks with every forest's scores of their rows."""
    known = blocks.sparkSession.sparkContext.broadcast(list(lookups))
    features, forests = len(lookups[0]), len(growths)

    def opened(row):
        bins, y, w = _arrays(row, features)
        return bins, y, w, np.full((forests, len(y)), base)

    def finer(i, trees):
        return symmetric_trees.in_finer_bins(trees, lookups[i])

    def scored(trees: dict):
        def run(block):
            bins, y, w, scores = block
            after = scores.copy()
            for i, of in trees.items():
                after[i] = symmetric_trees.add_trees(scores[i], bins, of)
            return bins, y, w, after

        return run

    state, old, steps = blocks.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK), None, 0
    held = [0] * forests  # trees of each forest that the scores hold
    try:
        while growing := [i for i, g in enumerate(growths) if not g.done]:
            if any(len(growths[i].trees) - held[i] >= checkpoint_every for i in growing):
                steps += 1
                # A lost block is made again by few steps: now and then the scores start from the written blocks.
                again = steps % MOST_STEPS == 0
                trees = {i: finer(i, growths[i].trees[0 if again else held[i] :]) for i in growing}
                old, state = state, (blocks.rdd.map(opened) if again else state).map(scored(trees)).persist(StorageLevel.MEMORY_AND_DISK)
                held = [len(g.trees) for g in growths]
            asked = {}
            for i in growing:
                levels, right = growths[i].wanted()
                asked[i] = (finer(i, growths[i].trees[held[i] :]), finer(i, [(levels, [])])[0][0], right, growths[i].width)

            def summed(some, asked=asked):
                totals = {}
                for bins, y, w, scores in some:
                    for i, (trees, levels, right, width) in asked.items():
                        g, h = symmetric_trees.slopes(symmetric_trees.add_trees(scores[i], bins, trees), y, w, step)
                        sums = symmetric_trees.histogram(bins, g, h, levels, right, width, known.value[i])
                        totals[i] = totals[i] + sums if i in totals else sums
                if totals:
                    yield totals

            added = lambda a, b: {i: a[i] + b[i] for i in a}
            partial = state.mapPartitions(summed)
            got = partial.reduce(added) if partial.getNumPartitions() <= MOST_PARTIALS else partial.treeReduce(added)
            if old is not None:
                old.unpersist()
                old = None
            for i, sums in got.items():
                growths[i].take(sums)
    finally:
        state.unpersist()
        known.destroy()


def raw_scores(models: Sequence[Forest], df: DataFrame) -> Column:
    """The log-odds of a row of ``df`` by each of ``models``, forests of the same features, as an array."""
    fine = _joint(models)
    lookups = [_lookups(m, fine) for m in models]
    grown = [(m.base, m.trees) for m in models]

    def scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            bins = np.stack([c.to_numpy(zero_copy_only=False) for c in columns])
            odds = [symmetric_trees.add_trees(np.full(bins.shape[1], base), _own(bins, at), trees) for at, (base, trees) in zip(lookups, grown)]
            ends = np.arange(bins.shape[1] + 1, dtype=np.int32) * len(odds)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(odds, axis=1).ravel()))

    scored.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(scored, "array<double>")(*[binned(F.col(f), b) for f, b in zip(models[0].features, fine)])


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def predict(model: Forest, df: DataFrame, out: str = "predicted_probability") -> DataFrame:
    """``df`` with the probability of class 1."""
    return df.withColumn(out, _probability(raw_scores([model], df)[0]))


def predict_many(models: Sequence[Forest], df: DataFrame, number: str, out: str = "predicted_probability") -> DataFrame:
    """``df`` once for each model, with the model's position and its probability of class 1."""
    every = df.select("*", F.posexplode(raw_scores(models, df)).alias(number, out))
    return every.withColumn(out, _probability(F.col(out)))


def splits_table(model: Forest, spark) -> DataFrame:
    """One row per tree level: tree, level, feature name, border (the split bin's upper border; null for the null bin), gain."""
    rows = []
    for t, ((levels, _), gains) in enumerate(zip(model.trees, model.gains)):
        for level, ((feature, split), gain) in enumerate(zip(levels, gains)):
            borders = model.borders[feature]
            rows.append((t, level, model.features[feature], float(borders[split]) if split < len(borders) else None, float(gain)))
    return spark.createDataFrame(rows, "tree int, level int, feature_name string, border double, gain double")
