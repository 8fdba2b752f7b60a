"""Ordered target statistics: a category's value for a row from the targets of earlier rows only.

Rows are put in a seeded order; a row's statistic for a category column is
``(sum of earlier targets of its category + prior * prior_weight) / (number of earlier targets + prior_weight)``,
so no row sees its own target. A window over a whole category would put a category of a third of the rows into one
task, so the order is cut into ranges (about ``rows_per_range`` rows each, a power of two in number): a small grouped
table holds each (category, range)'s sums, a window over that table carries the totals of all earlier ranges, and the
running sums are taken inside each (category, range) only. The carried totals are joined back on (category, range).

The order is a long column with values in ``[0, 2**order_bits)``; ``seeded_order`` gives a seeded permutation of
whole-number ids in that space. Rows tied in the order don't see each other (the frame ends before the row's order
value). Nulls: a null category is a category of its own; rows with a null target count for no one but get a value.
Rows with a null order are refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the seeded order: a multiplier and the prime modulus, so ids in [0, MODULUS) get distinct places.
MULTIPLIER, MODULUS, ORDER_BITS = 1_000_003, 2_147_483_647, 31
ROWS_PER_RANGE = 1_000_000


def seeded_order(id_col: str, seed: int = 42) -> Column:
    """``(id * MULTIPLIER + seed) mod MODULUS``: a seeded permutation of ids in ``[0, MODULUS)``, SQL-reproducible."""
    return F.pmod(F.col(id_col).cast("long") * F.lit(MULTIPLIER) + F.lit(seed), F.lit(MODULUS))


def ordered_statistics(
    df: DataFrame,
    categories: Sequence[str],
    target: str,
    order: Column,
    prior: float = 0.5,
    prior_weight: float = 1.0,
    rows_per_range: int = ROWS_PER_RANGE,
    order_bits: int = ORDER_BITS,
    suffix: str = "_ts",
) -> DataFrame:
    """``df`` with ``<category><suffix>`` for every category column."""
    rows = df.count()
    bits = min(order_bits, max(0, math.ceil(math.log2(rows / rows_per_range)))) if rows > rows_per_range else 0
    keyed = df.withColumns({"_o": order.cast("long"), "_y": F.col(target).cast("double")})
    bad = keyed.where(F.col("_o").isNull() | (F.col("_o") < 0) | (F.col("_o") >= F.lit(1 << order_bits))).limit(1).count()
    if bad:
        raise ValueError(f"the order must be a long in [0, 2**{order_bits}) on every row")
    keyed = keyed.withColumn("_r", F.shiftright("_o", order_bits - bits))
    earlier = lambda by: Window.partitionBy(*by).orderBy("_o").rangeBetween(Window.unboundedPreceding, -1)
    out = keyed
    for c in categories:
        totals = keyed.groupBy(c, "_r").agg(F.sum("_y").alias("s"), F.count("_y").alias("k"))
        before = Window.partitionBy(c).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            F.col(c).alias("_c"), F.col("_r").alias("_cr"),
            F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("_cs"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_ck"),
        )
        inside = out.withColumns(
            {"_ws": F.coalesce(F.sum("_y").over(earlier([c, "_r"])), F.lit(0.0)), "_wk": F.count("_y").over(earlier([c, "_r"]))}
        )
        joined = inside.join(carried, F.col(c).eqNullSafe(F.col("_c")) & (F.col("_r") == F.col("_cr")), "left")
        value = (F.col("_cs") + F.col("_ws") + F.lit(prior * prior_weight)) / (F.col("_ck") + F.col("_wk") + F.lit(prior_weight))
        out = joined.withColumn(f"{c}{suffix}", value).drop("_c", "_cr", "_cs", "_ck", "_ws", "_wk")
    return out.drop("_o", "_y", "_r")
