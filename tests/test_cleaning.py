import datetime as dt

import pytest
from frames import frame
from pyspark.sql import functions as F

from tranche import contracts
from tranche.functions import text
from tranche.operators import cleaning


def column(df, name):
    return [r[name] for r in df.collect()]


def test_text_normaliser(spark):
    df = frame(spark, "s string", ("\t Does  not\n meet ",), (None,), ("OK",))
    assert column(cleaning.normalise_text(df, ["s", "absent"]), "s") == ["does_not_meet", None, "ok"]
    kept = cleaning.normalise_text(df, ["s"], lowercase=False, underscores=False)
    assert column(kept, "s") == ["Does not meet", None, "OK"]


def test_percent_and_term(spark):
    df = frame(spark, "p string, t string", ("13.56%", " 36 months"), (None, "none"), (" 7 % ", None))
    out = cleaning.term_months(cleaning.percent_to_double(df, ["p"]), "t", "m")
    assert column(out, "p") == [13.56, None, 7.0]
    assert column(out, "m") == [36, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cleaning.percent_to_double(frame(spark, "p string", ("abc",)), ["p"]).collect()


def test_employment_years(spark):
    df = frame(spark, "e string", ("< 1 year",), ("1 year",), ("9 years",), ("10+ years",), ("N/A ",), ("n.a.",), (None,))
    assert column(cleaning.employment_years(df, "e"), "emp_length_years") == [0, 1, 9, 10, None, None, None]
    with pytest.raises(Exception, match="unmapped employment length: 11 years"):
        cleaning.employment_years(frame(spark, "e string", ("11 years",)), "e").collect()


def test_months(spark):
    df = frame(spark, "d string", ("Jan-2016",), (" Jan-85 ",), ("Dec-07",), (None,))
    expected = [dt.datetime(2016, 1, 1), dt.datetime(1985, 1, 1), dt.datetime(2007, 12, 1), None]
    assert column(cleaning.parse_months(df, ["d"]), "d") == expected
    with pytest.raises(Exception, match="unreadable month: soon"):
        cleaning.parse_months(frame(spark, "d string", ("soon",)), ["d"]).collect()


def test_sentinel_keeps_absence(spark):
    df = frame(spark, "m double", (3.0,), (None,))
    out = cleaning.sentinel(df, ["m"])
    assert [(r.has_m, r.m) for r in out.collect()] == [(1, 3.0), (0, 9999.0)]
    with pytest.raises(ValueError, match="already encoded"):
        cleaning.sentinel(out, ["m"])
    with pytest.raises(KeyError):
        cleaning.sentinel(df, ["absent"])


def test_mapping(spark):
    df = frame(spark, "s string", (" W ",), ("f",), (None,))
    assert column(cleaning.map_values(df, "s", cleaning.LIST_STATUS_NAMES), "s") == ["whole", "fractional", None]
    odd = frame(spark, "s string", ("x",))
    with pytest.raises(Exception, match="unmapped s: x"):
        cleaning.map_values(odd, "s", cleaning.LIST_STATUS_NAMES).collect()
    assert column(cleaning.map_values(odd, "s", {"a": "b"}, allow_unmapped=True), "s") == ["x"]


def test_home_ownership(spark):
    df = frame(spark, "home_ownership string", ("ANY",), (" none",), ("Rent",), (None,))
    assert column(cleaning.collapse_home_ownership(df), "home_ownership") == ["other", "other", "rent", None]


def test_row_ids_are_dense_and_repeats_fail(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"), (F.col("id") * 7).alias("k"))
    got = cleaning.with_row_ids(df, "k").toPandas()
    for _, part in got.groupby("split"):
        assert list(part.sort_values("k").row_id) == list(range(1, len(part) + 1))
    assert cleaning.with_row_ids(df.withColumnRenamed("k", "row_id"), "k").columns == ["split", "row_id"]
    with pytest.raises(Exception, match="repeated key"):
        cleaning.with_row_ids(df.withColumn("k", F.lit(1)), "k").collect()


def test_drop_report_and_type_alignment(spark):
    df = frame(spark, "a double, b bigint", (1.0, 2), (None, 3))
    kept, report = cleaning.drop_with_report(df, ["a", "zz", "a"], "d")
    assert kept.columns == ["b"]
    assert [tuple(r) for r in report.collect()] == [("d", "a", "dropped", 1), ("d", "zz", "missing", 0)]
    with pytest.raises(KeyError):
        cleaning.drop_with_report(df, ["zz"], "d", errors="raise")
    left, right = cleaning.align_numeric_types(df, df.withColumn("b", F.col("b").cast("int")))
    assert dict(left.dtypes) == dict(right.dtypes) == {"a": "double", "b": "double"}
    with pytest.raises(contracts.ContractViolation):
        cleaning.same_types(df, left)


def test_contracts(spark):
    df = frame(spark, "k bigint, v double", (1, 1.0), (1, None), (2, -1.0))
    checks = {r.contract: r.violations for r in contracts.row_checks(df, {"positive": F.col("v") > 0}).collect()}
    assert checks == {"positive": 2}
    with pytest.raises(contracts.ContractViolation, match="unique_key"):
        contracts.enforce(contracts.unique_key(df, "k"))
    sides = contracts.same_keys(df, df.filter("k = 1"), "k")
    assert [r.violations for r in sides.collect()] == [1, 0]
    contracts.enforce(contracts.same_keys(df, df, "k"))


def test_strip_handles_all_whitespace(spark):
    df = frame(spark, "s string", ("\x0b\f\r a b \t\n",))
    assert df.select(text.strip(F.col("s")).alias("s")).first().s == "a b"


def test_observed_write_counts_its_rows_and_fails_on_broken_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from tranche import contracts

    df = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.1)], "id long, score double")
    got = contracts.observed_write(df, str(tmp_path / "ok"), {"in_range": F.col("score").between(0, 1)}, "id", {"high": F.count_if(F.col("score") > 0.6)})
    assert (got["rows"], got["key_nulls"], got["in_range"], got["high"]) == (3, 0, 0, 1)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 3
    with pytest.raises(contracts.ContractViolation):
        contracts.observed_write(spark.createDataFrame([(None, 0.5)], "id long, score double"), str(tmp_path / "nokey"), {}, "id")
    bad = df.unionByName(spark.createDataFrame([(4, 1.5)], "id long, score double"))
    with pytest.raises(contracts.ContractViolation):
        contracts.observed_write(bad, str(tmp_path / "bad"), {"in_range": F.col("score").between(0, 1)})
    assert not (tmp_path / "bad").exists() and (tmp_path / "bad._staging").exists()
