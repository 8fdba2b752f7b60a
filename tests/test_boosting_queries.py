"""The catalogue's histogram boosting and search run at their published size."""

import datetime

import pytest

from tests.frames import frame
from tranche.operators import training
from tranche.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    customers = [(k, float(k * 37 % 900), segments[k % 5]) for k in range(60)]
    day = lambda k: datetime.datetime(1996 if k % 3 else 2001, 1 + k % 12, 1)
    orders = [(k, k * 7 % 60, "FP"[k * 11 % 5 < 2], 100.0 + k * 53 % 997, day(k), "1-URGENT") for k in range(600)]
    items = [(k, 1.0 + (k * 3 + j) % 50, (k + j) % 11 / 100) for k in range(600) for j in range(1 + k % 4)]
    made = {
        "customer": frame(spark, "c_custkey bigint, c_acctbal double, c_mktsegment string", *customers),
        "orders": frame(spark, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", *orders),
        "lineitem": frame(spark, "l_orderkey bigint, l_quantity double, l_discount double", *items),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_boosting_grows_500_trees_of_up_to_six_levels(spark, tables):
    rows = catalogue.queries()["m4_histogram_boosting"](spark, tables).collect()
    assert {r.tree for r in rows} == set(range(500)) and max(r.level for r in rows) == 5
    assert 0.5 < rows[0].train_auc <= 1.0 and 0.0 <= rows[0].test_auc <= 1.0


def test_search_runs_the_published_trials(spark, tables):
    rows = catalogue.queries()["m5_random_search_histogram"](spark, tables).collect()
    drawn = training.draw_trials(25)
    assert sorted(r.trial_index for r in rows) == list(range(25))
    assert all({n: r[n] for n in drawn[0]} == drawn[r.trial_index] for r in rows)
    assert min(r.iterations for r in rows) >= 300
    areas = [r.roc_auc for r in rows]
    assert areas == sorted(areas, reverse=True) and all(0.0 <= a <= 1.0 for a in areas)
