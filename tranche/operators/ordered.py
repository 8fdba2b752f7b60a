"""Order statistics over columns of any size: running totals, exact quantiles, bins.

Nothing here sorts or holds a whole group in one task. Values are counted first, so a
value that fills a third of the table becomes one row. The distinct values are then cut
into ranges at splitters taken from a deterministic sample of them (the values with the
smallest hashes), each range is totalled, and only the range totals - at most
``ranges`` rows per group - pass through a single window. Rows are sorted range by range.

``by`` columns must be few-valued labels (split, feature name, model name) without nulls:
the splitters and the range totals are broadcast, and their size is number of labels
times number of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tranche.functions.shape import fitted, record


def ranges_for(spark: SparkSession) -> int:
    """As many ranges as there are shuffle partitions: both broadcasts have a row or value for each of these and label."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _cuts_before(value: Column, most: int, descending: bool) -> Column:
    """How many of the sorted ``_cuts`` come before ``value``: whole blocks first, then one block."""
    block = max(1, math.isqrt(most))

    def before(cut: Column) -> Column:
        return cut > value if descending else cut < value

    ends = F.filter("_cuts", lambda cut, i: ((i + 1) % block == 0) & before(cut))
    if most <= 2 * block or most < 32:
        return F.size(F.filter("_cuts", before))
    whole = F.size(ends) * block
    return whole + F.size(F.filter(F.slice("_cuts", whole + 1, F.lit(block)), before))


@dataclass(frozen=True)
class RangedTotals:
    """``rows``: by, value, weights, _range. ``ranges``: totals and offsets per range."""

    rows: DataFrame
    ranges: DataFrame


def _cut_into_ranges(
    totals: DataFrame, by: Sequence[str], value: str, weights: Sequence[str], descending: bool = False
) -> RangedTotals:
    by = list(by)
    wanted = ranges_for(totals.sparkSession)
    sample_order = W.partitionBy(*by).orderBy(F.xxhash64(value), F.col(value))
    # The weight filter keeps every row (weights are counts); it makes this branch read the
    # same columns as the others, so the shuffle below the totals is run once and reused.
    weighted = totals.filter(sum((F.col(w) for w in weights), F.lit(0)) >= 0)
    cuts = (
        weighted.select(*by, value, F.row_number().over(sample_order).alias("_rank"))
        .filter(F.col("_rank") < wanted)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(value), asc=not descending).alias("_cuts"))
    )
    # Bounded broadcast: one row per label, fewer values in it than there are ranges.
    rows = totals.join(F.broadcast(cuts), by).select(
        *by, value, *weights, _cuts_before(F.col(value), wanted, descending).alias("_range")
    )

    first = F.max_by if descending else F.min_by
    head = record(**{f"next_{w}": F.col(w) for w in weights})
    in_order = W.partitionBy(*by).orderBy("_range")
    whole = W.partitionBy(*by)
    ranges = rows.groupBy(*by, "_range").agg(
        *[F.sum(w).alias(f"_in_{w}") for w in weights], first(head, F.col(value)).alias("_head")
    )
    ranges = ranges.select(
        *by,
        "_range",
        *[
            F.coalesce(F.sum(f"_in_{w}").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(
                f"_offset_{w}"
            )
            for w in weights
        ],
        *[F.sum(f"_in_{w}").over(whole).alias(f"all_{w}") for w in weights],
        *[F.col(f"_in_{w}") for w in weights],
        F.lead("_head").over(in_order).alias("_next_head"),
    )
    return RangedTotals(rows, ranges)


def running_totals(
    totals: DataFrame,
    by: Sequence[str],
    value: str,
    weights: Sequence[str],
    descending: bool = False,
    with_next: bool = False,
) -> DataFrame:
    """Add ``before_<w>`` (sum over earlier values) and ``all_<w>`` (sum over the group).

    ``totals`` has one row per (by, value); ``weights`` are non-negative counts.
    ``with_next`` also adds ``next_<w>``, the weight of the following value.
    """
    by = list(by)
    cut = _cut_into_ranges(totals, by, value, weights, descending)
    offsets = cut.ranges.select(
        *by,
        "_range",
        *[f"_offset_{w}" for w in weights],
        *[f"all_{w}" for w in weights],
        *(["_next_head"] if with_next else []),
    )
    # Bounded broadcast: at most a row per label and range.
    joined = cut.rows.join(F.broadcast(offsets), [*by, "_range"])
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = W.partitionBy(*by, "_range").orderBy(order)
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    result = joined.select(
        *by,
        value,
        *weights,
        *[(F.col(f"_offset_{w}") + F.sum(w).over(so_far) - F.col(w)).alias(f"before_{w}") for w in weights],
        *[F.col(f"all_{w}") for w in weights],
        *(
            [
                F.coalesce(F.lead(w).over(inside), F.col(f"_next_head.next_{w}")).alias(f"next_{w}")
                for w in weights
            ]
            if with_next
            else []
        ),
    )
    return result


def dense_positions(df: DataFrame, by: Sequence[str], key: str, name: str) -> DataFrame:
    """(by, key, n, name): 1-based position of each distinct ``key`` value within its group."""
    distinct = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1).cast("bigint"))
    placed = running_totals(distinct, by, key, ["one", "n"])
    return placed.select(*by, key, "n", (F.col("before_one") + 1).alias(name))


def select_ranks(
    counts: DataFrame, by: Sequence[str], value: str, wanted: Callable[[Column], Column]
) -> DataFrame:
    """(by, tag, rank, value): the values at the 0-based ranks that ``wanted`` asks for.

    ``counts`` has one row per (by, value) with its count ``n``. ``wanted`` maps the group size
    to a short array of (tag, rank) structs. Only the ranges that hold a wanted rank are sorted.
    """
    by = list(by)
    cut = _cut_into_ranges(counts, by, value, ["n"])
    start = F.col("_offset_n")
    end = start + F.col("_in_n")
    inside_range = F.filter(wanted(F.col("all_n")), lambda t: (t["rank"] >= start) & (t["rank"] < end))
    hit = (
        cut.ranges.withColumn("_targets", inside_range)
        .filter(F.size("_targets") > 0)
        .select(*by, "_range", "_offset_n", "_targets")
    )
    inside = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    # Bounded broadcast: at most a row per label and range.
    placed = cut.rows.join(F.broadcast(hit), [*by, "_range"]).select(
        *by,
        value,
        "n",
        "_targets",
        (F.col("_offset_n") + F.sum("n").over(inside) - F.col("n")).alias("before_n"),
    )
    first, last = F.col("before_n"), F.col("before_n") + F.col("n")
    return (
        placed.withColumn("_targets", F.filter("_targets", lambda t: (t["rank"] >= first) & (t["rank"] < last)))
        .select(*by, value, F.explode("_targets").alias("_target"))
        .select(*by, value, "_target.tag", "_target.rank")
    )


def value_counts_of(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, _value, n): how often each non-null value occurs, as double."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """(by, probability, quantile): exact quantiles with linear interpolation, nulls ignored.

    Groups without any value give no row.
    """
    return quantiles_of_counts(value_counts_of(df, by, value), by, "_value", probabilities)


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """As :func:`exact_quantiles`, from a table of (by, value, n)."""
    ends = quantile_ends(counts, by, value, probabilities)
    between = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    return ends.select(*by, "probability", between.alias("quantile"))


def _found_ends(counts: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """(by, tag, rank, value): the one or two values next to each quantile."""

    def spots(size: Column) -> Column:
        targets = []
        for p in probabilities:
            spot = F.lit(float(p)) * (size - 1)
            tag = record(probability=float(p), share=spot - F.floor(spot))
            targets += [record(tag=tag, rank=F.floor(spot)), record(tag=tag, rank=F.ceil(spot))]
        return F.array(*targets)

    return select_ranks(counts, by, value, spots)


def quantile_ends(counts: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """(by, probability, low, high, share): the neighbours each quantile lies between, and where."""
    by = list(by)
    return (
        _found_ends(counts, by, value, probabilities)
        .groupBy(*by, "tag")
        .agg(F.min(value).alias("low"), F.max(value).alias("high"))
        .select(*by, "tag.probability", "low", "high", "tag.share")
    )


def _quantile_at(value: str, probability: float) -> Column:
    """Aggregate over found ends: the interpolated quantile."""
    here = F.col("tag.probability") == F.lit(float(probability))
    low, high = F.min(F.when(here, F.col(value))), F.max(F.when(here, F.col(value)))
    return low + (high - low) * F.max(F.when(here, F.col("tag.share")))


def exact_quantile_columns(df: DataFrame, by: Sequence[str], value: str, names: dict[float, str]) -> DataFrame:
    """One row per group with one column per probability."""
    found = _found_ends(value_counts_of(df, by, value), by, "_value", list(names))
    return found.groupBy(*by).agg(*[_quantile_at("_value", p).alias(name) for p, name in names.items()])


def bin_edges(df: DataFrame, by: Sequence[str], value: str, bins: int, drop_duplicates: bool = True) -> DataFrame:
    """(by, edges): ascending quantile edges of equal-count bins; equal edges are merged.

    Fits at once: the edges are a few numbers per label and constants of whatever uses them.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    cuts = [i / bins for i in range(bins + 1)]
    found = _found_ends(value_counts_of(df, by, value), by, "_value", cuts)
    wide = found.groupBy(*by).agg(F.array(*[_quantile_at("_value", p) for p in cuts]).alias("edges"))
    return fitted(wide.select(*by, F.array_distinct("edges").alias("edges")) if drop_duplicates else wide)


def with_bin(
    df: DataFrame, edges: DataFrame, by: Sequence[str], value: str, bins: int, name: str = "bin"
) -> DataFrame:
    """Right-closed bin number 1..k by the ``edges`` of the row's group; null outside the edges.

    ``bins`` is the number of bins the edges were fitted for: it fixes how many comparisons are
    compiled. ``edges`` is one small row per label and is broadcast.
    """
    v = F.col(value).cast("double")
    inner = [F.coalesce((F.get("edges", F.lit(i)) < v).cast("int"), F.lit(0)) for i in range(1, bins)]
    # The last edge closes the last bin: values up to it are inside, so it must not be counted.
    number = F.least(sum(inner, F.lit(1)), F.size("edges") - 1)
    inside = (v >= F.get("edges", F.lit(0))) & (v <= F.element_at("edges", -1))
    joined = df.join(F.broadcast(edges), list(by), "left")
    return joined.withColumn(name, F.when(inside, number)).drop("edges")


def bin_spine(edges: DataFrame, by: Sequence[str], name: str = "bin") -> DataFrame:
    """(by, bin, bin_low, bin_high): every bin, so that empty ones are kept."""
    at = F.sequence(F.lit(1), F.size("edges") - 1)
    return edges.filter(F.size("edges") > 1).select(
        *by,
        F.explode(
            F.transform(
                at,
                lambda i: record(
                    **{name: i}, bin_low=F.element_at("edges", i), bin_high=F.element_at("edges", i + 1)
                ),
            )
        ).alias("_b"),
    ).select(*by, "_b.*")


def bin_label(low: str = "bin_low", high: str = "bin_high", digits: int = 4) -> Column:
    """``(low, high]`` as display text."""
    return F.format_string(f"(%.{digits}f, %.{digits}f]", F.col(low), F.col(high))
