import numpy as np
import pytest

from tranche.operators import target_statistics as ts


def brute(rows, prior=0.5, weight=1.0):
    """Each row against all rows of its category with a smaller order value, directly."""
    out = {}
    for rid, cat, y, o in rows:
        prev = [r[2] for r in rows if r[1] == cat and r[3] < o and r[2] is not None]
        out[rid] = (sum(prev) + prior * weight) / (len(prev) + weight)
    return out


def table(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    cats = ["hot"] * (n // 3) + list(rng.choice(["a", "b", "c", None], n - n // 3))
    rows = []
    for i in range(n):
        y = None if i % 29 == 0 else int(rng.random() < 0.3)
        rows.append((i, cats[i], y, int(rng.integers(0, 40)) if i % 2 else i * 1000))  # ties in the order too
    return rows, spark.createDataFrame(rows, "rid long, cat string, y int, o long")


@pytest.mark.parametrize("per_range", [1_000_000, 7])
def test_equals_the_direct_window(spark, per_range):
    rows, df = table(spark)
    got = {r.rid: r.cat_ts for r in ts.ordered_statistics(df, ["cat"], "y", df["o"], rows_per_range=per_range).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_row_sees_its_own_target(spark):
    df = spark.createDataFrame([(i, "x", 1, i) for i in range(10)], "rid long, cat string, y int, o long")
    got = sorted((r.rid, r.cat_ts) for r in ts.ordered_statistics(df, ["cat"], "y", df["o"], rows_per_range=3, order_bits=4).collect())
    assert got[0][1] == 0.5 and got[1][1] == 0.75 and got[9][1] == pytest.approx(9.5 / 10)


def test_seeded_order_is_a_permutation_and_refuses_out_of_range(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    places = [r.o for r in df.select(ts.seeded_order("row_id").alias("o")).collect()]
    assert len(set(places)) == 1000 and all(0 <= p < ts.MODULUS for p in places)
    bad = spark.createDataFrame([(1, "x", 1, -5)], "rid long, cat string, y int, o long")
    with pytest.raises(ValueError):
        ts.ordered_statistics(bad, ["cat"], "y", bad["o"])
    assert ts.ordered_statistics(bad.limit(0), ["cat"], "y", bad["o"]).count() == 0
