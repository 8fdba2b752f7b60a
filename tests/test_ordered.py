import numpy as np
import pandas as pd
import pytest
from frames import frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tranche.operators import ordered


def values_of(rows, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in rows}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=120))
def test_quantiles_equal_numpy(spark, numbers):
    df = frame(spark, "g string, x double", *[("a", float(x)) for x in numbers])
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.probability: r.quantile for r in ordered.exact_quantiles(df, ["g"], "x", probabilities).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(float(np.quantile(numbers, p)), rel=1e-12, abs=1e-9)


def test_quantiles_with_one_value_in_a_third_of_all_rows(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 37 % 1000).cast("double")).alias("x"),
    )
    got = values_of(ordered.exact_quantiles(df, ["g"], "x", [0.1, 0.5, 0.77]).collect(), "g", "probability", "quantile")
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for p in (0.1, 0.5, 0.77):
            assert got[(g, p)] == pytest.approx(float(part.x.quantile(p)))


def test_block_search_agrees_with_plain_counting(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        df = spark.range(2000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 2003).cast("double").alias("x"))
        got = [r.quantile for r in ordered.exact_quantiles(df, ["g"], "x", [0.5]).collect()]
        totals = df.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
        down = ordered.running_totals(totals, ["g"], "x", ["n"], descending=True, with_next=True).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == [float(df.toPandas().x.median())]
    down = down.sort_values("x", ascending=False).reset_index(drop=True)
    assert (down.before_n == np.arange(len(down))).all()
    assert down.next_n.isna().sum() == 1


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(500).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 31 % 997).alias("k"))
    placed = ordered.dense_positions(df, ["g"], "k", "p").toPandas()
    for _, part in placed.groupby("g"):
        part = part.sort_values("k")
        assert list(part.p) == list(range(1, len(part) + 1))


def test_bins_are_right_closed_with_lowest_included(spark):
    numbers = [1, 2, 2, 3, 10, 20, 7, 7, 5]
    df = frame(spark, "g string, x double", *[("a", float(x)) for x in numbers])
    edges = ordered.bin_edges(df, ["g"], "x", 4)
    assert edges.first().edges == [1.0, 2.0, 5.0, 7.0, 20.0]
    binned = ordered.with_bin(df, edges, ["g"], "x", 4).toPandas()
    expected = pd.cut(binned.x, [1, 2, 5, 7, 20], include_lowest=True, labels=False) + 1
    assert list(binned.bin) == list(expected)
    other = frame(spark, "g string, x double", ("a", 0.5), ("a", 21.0), ("a", 1.0), ("a", 20.0))
    got = {r.x: r.bin for r in ordered.with_bin(other, edges, ["g"], "x", 4).collect()}
    assert got == {0.5: None, 21.0: None, 1.0: 1, 20.0: 4}


def test_equal_edges_are_merged(spark):
    df = frame(spark, "g string, x double", *[("a", 1.0)] * 8, ("a", 2.0), ("a", 3.0))
    edges = ordered.bin_edges(df, ["g"], "x", 5).first().edges
    _, expected = pd.qcut(pd.Series([1.0] * 8 + [2, 3]), 5, retbins=True, duplicates="drop")
    assert edges == pytest.approx(list(expected))
    kept = ordered.bin_edges(df, ["g"], "x", 5, drop_duplicates=False).first().edges
    assert len(kept) == 6
