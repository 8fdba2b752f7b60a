"""Hard-negative mining by L2AP-style threshold joins between anchors and all rows.

Each anchor needs its best rows of the same label (positives) and, for each positive, the best rows of another label
whose score lies in a window below the positive's. Both are top-k searches, found as threshold joins: a first round
asks for every row scoring at least a high threshold; anchors (or anchor-positive pairs) whose window is not yet full
come back with a lower threshold, down to the window's floor (or to no floor at all for positives), so every result is
exact. Rows and anchors meet in blocks: rows are dealt to groups of about ``ROWS_PER_GROUP``, anchors to blocks of about
``ANCHORS_PER_BLOCK``; every (group, block) pair is one task, so no task holds more than a bounded number of either.

Within a task the join is L2AP's: dimensions are taken from the last to the first; the leading dimensions whose norm
bound cannot reach the smallest threshold (largest row prefix norm times largest anchor norm below it) are left out of
the index and only read to verify. After each chunk of indexed dimensions a pair is pruned when its partial score plus
the product of the remaining norms (Cauchy-Schwarz) is below its threshold. Survivors are verified exactly.

Scores are integer inner products of ``floor(256 * x)`` components, computed in float64 only when every partial sum
is below 2**53 (checked), else in int64. Rows with a null id, label or vector, or a null or non-finite component, take
no part. Vectors of unequal length count missing components as 0. Exact repeated rows count once; an anchor is never
its own positive, nor is any row with its id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tranche.llm.common import written_once

ANCHOR_EVERY, RELABEL_EVERY, CLASSES, SCALE = 50, 7, 10, 256
POSITIVES, NEGATIVES = 5, 3
#: A negative n of a positive p lies in LOW * p <= 100 * n <= HIGH * p.
LOW, HIGH = 50, 95
#: Rows of a task's group, anchors of a task's block: the bounds of a task's memory.
ROWS_PER_GROUP, ANCHORS_PER_BLOCK = 20_000, 1_000
#: Thresholds of the positives' rounds, as shares of the anchor's norm times the largest row norm; then no threshold.
POSITIVE_SHARES = (0.5, 0.25, 0.1, 0.0)
#: Thresholds of the negatives' rounds, as shares of the positive's score; the last is the window's floor.
NEGATIVE_SHARES = (0.85, 0.7, 0.5)
#: Indexed dimensions taken at once before pruning.
CHUNK = 16
#: Anchors scored against a group at once (their score matrix is this many rows by the group's).
SUBBLOCK = 128
#: Pairs whose rows are gathered at once when surviving pairs are scored further.
PAIRS = 1 << 17

#: DuckDB SQL of the same rows by brute force: every anchor against every row.
ORACLE_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))), true)
),
anchors AS (SELECT vec_id AS anchor_id, label, q FROM rows WHERE vec_id % 50 = 0),
scored AS (
  SELECT a.anchor_id, a.label AS anchor_label, r.vec_id, r.label,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, r.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS score
  FROM anchors a, rows r
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k
        FROM scored WHERE label = anchor_label AND vec_id <> anchor_id)
  WHERE k <= 5
),
negatives AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id
  WHERE s.label <> s.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3
"""

FOUND = T.StructType(
    [
        T.StructField("anchor_id", T.LongType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("score", T.LongType()),
        T.StructField("found", T.LongType()),
    ]
)


def prepared(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, q)`` of the rows that take part: labels moved where the id is divisible by 7, components scaled."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    moved = F.when(F.col(vec_id) % RELABEL_EVERY == 0, (F.col(label) + 1) % CLASSES).otherwise(F.col(label))
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), moved.cast("long").alias("label"), q.alias("q")).distinct()


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def pair_dots(x: np.ndarray, y: np.ndarray, ai: np.ndarray, yi: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """``x[ai, lo:hi] . y[yi, lo:hi]`` per pair, gathered ``PAIRS`` pairs at a time so that memory stays bounded."""
    out = np.empty(len(ai), dtype=np.int64)
    for s in range(0, len(ai), PAIRS):
        a, b = ai[s : s + PAIRS], yi[s : s + PAIRS]
        out[s : s + PAIRS] = np.einsum("ij,ij->i", x[a, lo:hi], y[b, lo:hi])
    return out


def threshold_pairs(x: np.ndarray, t: np.ndarray, y: np.ndarray, eligible: np.ndarray):
    """``(anchor, row, score)`` of all eligible pairs with ``x @ y >= t``, by L2AP's index omission and norm pruning."""
    d = x.shape[1]
    if not len(x) or not len(y) or d == 0:
        ai, yi = np.nonzero(eligible & (t[:, None] <= 0))
        return ai, yi, np.zeros(len(ai), np.int64)
    exact = float(np.abs(x).max()) * float(np.abs(y).max()) * d < 2**53
    xs, ys = (x.astype(np.float64), y.astype(np.float64)) if exact else (x, y)
    x_pre = np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(x.astype(np.float64) ** 2, axis=1)], axis=1))
    y_pre = np.sqrt(np.concatenate([np.zeros((len(y), 1)), np.cumsum(y.astype(np.float64) ** 2, axis=1)], axis=1))
    # Index omission: the leading dimensions whose bound cannot reach the smallest threshold are not indexed.
    reach = y_pre.max(axis=0) * x_pre[:, -1].max() * (1 + 1e-9)
    low = t.min()
    start = int(np.searchsorted(reach >= low, True)) - 1 if np.isfinite(low) and low > 0 else 0
    start = max(start, 0)
    hi = d
    lo = max(start, hi - CHUNK)
    partial = (xs[:, lo:hi] @ ys[:, lo:hi].T).astype(np.int64) if exact else x[:, lo:hi] @ y[:, lo:hi].T
    bound = partial + np.floor(x_pre[:, lo][:, None] * y_pre[:, lo][None, :] * (1 + 1e-9) + 1)
    ai, yi = np.nonzero(eligible & (bound >= t[:, None]))
    acc = partial[ai, yi]
    hi = lo
    while hi > start and len(ai):
        lo = max(start, hi - CHUNK)
        acc = acc + pair_dots(x, y, ai, yi, lo, hi)
        keep = acc + np.floor(x_pre[ai, lo] * y_pre[yi, lo] * (1 + 1e-9) + 1) >= t[ai]
        ai, yi, acc = ai[keep], yi[keep], acc[keep]
        hi = lo
    # Verification: the omitted dimensions, read only for the survivors.
    if start > 0 and len(ai):
        acc = acc + pair_dots(x, y, ai, yi, 0, start)
    keep = acc >= t[ai]
    return ai[keep], yi[keep], acc[keep]


def best(anchor_ids, slots, vec_ids, scores, k: int) -> pd.DataFrame:
    """The first ``k`` of each (anchor, slot) by score descending, then id; the first carries the number found."""
    found = pd.DataFrame({"anchor_id": anchor_ids, "slot": slots, "vec_id": vec_ids, "score": scores})
    if found.empty:
        return found.assign(found=np.zeros(0, np.int64))
    found = found.sort_values(["anchor_id", "slot", "score", "vec_id"], ascending=[True, True, False, True], kind="stable")
    counts = found.groupby(["anchor_id", "slot"])["vec_id"].transform("size")
    head = found.groupby(["anchor_id", "slot"], sort=False).cumcount() == 0
    # The number found stands on the first row of each (anchor, slot) only, so that sums over tasks count it once.
    return found.assign(found=np.where(head, counts, 0)).groupby(["anchor_id", "slot"], sort=False).head(k)


def positive_task(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    """Per anchor: its first POSITIVES rows of the group at or above its threshold, same label, another id."""
    if rows.empty or anchors.empty:
        return pd.DataFrame({c.name: [] for c in FOUND.fields})
    width = max(max(len(v) for v in rows["q"]), max(len(v) for v in anchors["q"]))
    y = matrix(rows["q"], width)
    out = []
    for s in range(0, len(anchors), SUBBLOCK):
        part = anchors.iloc[s : s + SUBBLOCK]
        x = matrix(part["q"], width)
        eligible = (part["label"].to_numpy()[:, None] == rows["label"].to_numpy()[None, :]) & (
            part["anchor_id"].to_numpy()[:, None] != rows["vec_id"].to_numpy()[None, :]
        )
        ai, yi, sc = threshold_pairs(x, part["t"].to_numpy(np.float64), y, eligible)
        out.append(best(part["anchor_id"].to_numpy()[ai], np.zeros(len(ai), np.int32), rows["vec_id"].to_numpy()[yi], sc, POSITIVES))
    return pd.concat(out)[[c.name for c in FOUND.fields]]


def negative_task(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    """Per (anchor, positive slot): its first NEGATIVES rows of the group of another label inside the window, at or above t."""
    if rows.empty or anchors.empty:
        return pd.DataFrame({c.name: [] for c in FOUND.fields})
    width = max(max(len(v) for v in rows["q"]), max(len(v) for v in anchors["q"]))
    y = matrix(rows["q"], width)
    out = []
    for s in range(0, len(anchors), SUBBLOCK):
        part = anchors.iloc[s : s + SUBBLOCK]
        x = matrix(part["q"], width)
        eligible = part["label"].to_numpy()[:, None] != rows["label"].to_numpy()[None, :]
        lowest = np.array([min(ts) for ts in part["ts"]], np.float64)
        ai, yi, sc = threshold_pairs(x, lowest, y, eligible)
        for k in range(POSITIVES):
            has = np.array([len(ts) > k for ts in part["ts"]])
            p = np.array([ps[k] if len(ps) > k else 0 for ps in part["ps"]], np.int64)
            t = np.array([ts[k] if len(ts) > k else np.inf for ts in part["ts"]], np.float64)
            inside = has[ai] & (sc >= t[ai]) & (LOW * p[ai] <= 100 * sc) & (100 * sc <= HIGH * p[ai])
            slots = np.array([sl[k] if len(sl) > k else -1 for sl in part["slots"]], np.int32)
            out.append(best(part["anchor_id"].to_numpy()[ai[inside]], slots[ai[inside]], rows["vec_id"].to_numpy()[yi[inside]], sc[inside], NEGATIVES))
    return pd.concat(out)[[c.name for c in FOUND.fields]]


def blocked(rows: DataFrame, anchors: DataFrame, task, groups: int, blocks: int) -> DataFrame:
    """Every group of rows against every block of anchors, one task a pair, through a cogroup on (group, block)."""
    near = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    far = anchors.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return near.groupBy("grp", "block").cogroup(far.groupBy("grp", "block")).applyInPandas(
        lambda r, a: task(r.drop(columns=["grp", "block"]), a.drop(columns=["grp", "block"])), FOUND
    )


def first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each (anchor, slot) over all groups, with the total found."""
    by = Window.partitionBy("anchor_id", "slot")
    ranked = found.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), "vec_id")))
    return ranked.withColumn("total", F.sum("found").over(by)).where(F.col("rank") <= k)


def mine(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", anchor: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and positive.

    Anchors are the taking-part rows where ``anchor`` holds (default: id divisible by 50). Other columns are ignored.
    """
    spark = df.sparkSession
    rows = written_once(prepared(df, vec_id, vector, label), "negatives-rows")
    n_rows, largest = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x)))).first()
    if not n_rows:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    groups = max(1, math.ceil(n_rows / ROWS_PER_GROUP))
    rows = written_once(rows.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")), "negatives-groups")
    chosen = anchor if anchor is not None else F.col("vec_id") % ANCHOR_EVERY == 0
    anchors = rows.where(chosen).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("label"), F.col("q").alias("q"))
    n_anchors = anchors.count()
    blocks = max(1, math.ceil(n_anchors / ANCHORS_PER_BLOCK))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))

    # Positives: lower the threshold until each anchor has POSITIVES rows or no threshold is left.
    kept, open_ = [], anchors
    for share in [*POSITIVE_SHARES, None]:
        t = F.lit(float("-inf")) if share is None else norm * float(largest or 0.0) * share
        found = written_once(first(blocked(rows, open_.withColumn("t", t), positive_task, groups, blocks), POSITIVES), "negatives-positives")
        full = found.where(F.col("total") >= POSITIVES) if share is not None else found
        kept.append(full)
        done = full.select("anchor_id").distinct()
        open_ = open_.join(done, "anchor_id", "left_anti")
    positives = kept[0]
    for more in kept[1:]:
        positives = positives.unionByName(more)
    positives = written_once(positives.select("anchor_id", F.col("rank").cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-chosen")

    # Negatives: per positive, lower the threshold from a share of its score to its window's floor.
    pairs = positives.where(F.col("positive_score") >= 0).join(anchors, "anchor_id")
    got = []
    for n, share in enumerate(NEGATIVE_SHARES):
        floor_ = F.ceil(F.col("positive_score") * LOW / 100).cast("double")
        t = F.greatest(floor_, F.col("positive_score") * share)
        open_pairs = pairs.withColumn("t", t).groupBy("anchor_id", "label", "q", "block").agg(
            F.sort_array(F.collect_list(F.struct("slot", "positive_score", "t"))).alias("open")
        )
        open_pairs = open_pairs.select("anchor_id", "label", "q", "block", F.col("open.slot").alias("slots"), F.col("open.positive_score").alias("ps"), F.col("open.t").alias("ts"))
        found = written_once(first(blocked(rows, open_pairs, negative_task, groups, blocks), NEGATIVES), "negatives-found")
        last = n == len(NEGATIVE_SHARES) - 1
        full = found if last else found.where(F.col("total") >= NEGATIVES)
        got.append(full)
        pairs = pairs.join(full.select("anchor_id", "slot").distinct(), ["anchor_id", "slot"], "left_anti")
    negatives = got[0]
    for more in got[1:]:
        negatives = negatives.unionByName(more)
    out = negatives.join(positives, ["anchor_id", "slot"])
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
