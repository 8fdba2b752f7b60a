import datetime

import duckdb

from tranche.plans import catalogue
from tranche.sources import dirty_csv, storage

TEXT = '''Notes offered by Prospectus (https://example.org)
"id","term","note"
1," 36 months","plain"

2," 60 months","two
lines and ""quotes"""
,,
"id","term","note"
short,row
a,b,c,d
 , ,
3, 36 months,last
Total amount funded: 1000
'''


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_normalise_and_counts(spark, tmp_path):
    path = write(tmp_path, "a.csv", TEXT)
    assert dirty_csv.read_header(spark, path) == ["id", "term", "note"]
    rows = dirty_csv.normalise(spark, path).orderBy("id").collect()
    assert [(r.id, r.note) for r in rows] == [("1", "plain"), ("2", 'two\nlines and "quotes"'), ("3", "last")]
    counts = dirty_csv.normalisation_counts(spark, path).first().asDict()
    assert counts == {
        "source_file": "a.csv",
        "source_row_count": 12,
        "staged_row_count": 4,
        "removed_non_tabular_row_count": 4,
        "removed_repeated_header_row_count": 1,
        "removed_blank_row_count": 3,
    }


def test_header_check_summary_and_concatenation(spark, tmp_path):
    write(tmp_path, "a.csv", TEXT)
    write(tmp_path, "b.csv", 'preamble\n"id","term","other"\n7,8,9\n')
    got = {r.source_file: r.matches_reference_schema for r in dirty_csv.header_consistency(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": True, "b.csv": False}
    staged = dirty_csv.normalise(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in dirty_csv.source_summary(staged).collect()] == [("a.csv", 3, 3, 3)]
    raw = dirty_csv.concatenate([staged, staged], [staged])
    assert {r.split: r.row_count for r in dirty_csv.concatenation_summary(raw).collect()} == {"train": 6, "test": 3}


def test_preview_of_a_short_file(spark, tmp_path):
    path = write(tmp_path, "c.csv", "\n".join(["x" * 300] + [f"line {i}" for i in range(1, 20)]) + "\n")
    rows = dirty_csv.preview(spark, path).collect()
    head = [r for r in rows if r.section == "head"]
    tail = [r for r in rows if r.section == "tail"]
    assert [r.line_number for r in head] == list(range(8)) and len(head[0].preview) == 250
    assert [r.line_number for r in tail] == list(range(12, 20)) and tail[-1].preview == "line 19"


def test_inferred_types(spark, tmp_path):
    path = write(tmp_path, "d.csv", "a,b,c,d\n1,1.5,x,\n2,2,,\n")
    staged = dirty_csv.normalise(spark, path).drop("source_file")
    types = {r.column_name: r.inferred_type for r in dirty_csv.inferred_types(staged).collect()}
    assert types == {"a": "bigint", "b": "double", "c": "string", "d": "double"}
    assert dict(dirty_csv.with_inferred_types(staged).dtypes) == types


def test_csv_keeps_quotes_and_layers_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', "train"), (2, None, "test")], "id bigint, s string, split string")
    storage.write_csv(df, str(tmp_path / "csv"))
    back = storage.read_csv(spark, str(tmp_path / "csv"), "id bigint, s string, split string")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    storage.write_layer(df, str(tmp_path / "layer"))
    test = storage.read_layer(spark, str(tmp_path / "layer"), "test")
    assert [r.id for r in test.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()


def test_split_quoted_records_equal_the_whole_file_reader(spark, tmp_path):
    from tranche.sources import dirty_csv

    lines = ['"id","note"']
    for i in range(400):
        note = f'"line {i}\nstill {i}, ""q""\n\nend"' if i % 3 == 0 else f"plain {i}"
        lines.append(f"{i},{note}")
        if i % 50 == 0:
            lines += ["", "   "]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        parts = dirty_csv.text_lines(spark, str(tmp_path)).select("block").distinct().count()
        split = dirty_csv.classified_rows(spark, str(tmp_path), ["id", "note"], split_quoted=True)
        whole = dirty_csv.classified_rows(spark, str(tmp_path), ["id", "note"])
        key = lambda r: (r.row_class, r._c0, r._c1)
        assert parts >= 4
        assert sorted(map(key, split.collect())) == sorted(map(key, whole.collect()))
        assert split.where("row_class = 'data'").count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_row_of_a_headless_file_may_hold_a_line_break(spark, tmp_path):
    """The first record with cells is read whole, wherever in the file it begins or ends."""
    write(tmp_path, "a.csv", '"Notes,\noffered"\n"id","term","note"\n1,2,x\n')
    write(tmp_path, "b.csv", '"Notes, offered"\n10,2,"x, ""late""\nnext, line"\n11,2,y\n')
    write(tmp_path, "c.csv", 'about 5" of notes\n' + "line\n" * dirty_csv.HEAD_LINES * 2 + '20,2,"' + "more\n" * dirty_csv.HEAD_LINES + '"\n')
    headers = {r.source_file: r.header for r in dirty_csv.first_tabular_lines(spark, str(tmp_path)).collect()}
    assert headers == {"a.csv": ["id", "term", "note"], "b.csv": ["10", "2", 'x, "late"\nnext, line'], "c.csv": ["20", "2", "more\n" * dirty_csv.HEAD_LINES]}
    for split in (False, True):
        rows = dirty_csv.normalise(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv")], split_quoted=split).collect()
        assert sorted((r.id, r.note) for r in rows) == [("1", "x"), ("10", 'x, "late"\nnext, line'), ("11", "y")]
        counts = dirty_csv.normalisation_counts(spark, str(tmp_path / "b.csv"), ["id", "term", "note"], split_quoted=split).first()
        assert (counts.staged_row_count, counts.removed_non_tabular_row_count, counts.source_row_count) == (2, 1, 3)


def test_queries_on_orders_whose_headless_file_starts_with_a_line_break(spark, tmp_path):
    """1996 files have no header; the first row of one of them goes on in the next line. All queries equal their SQL."""
    keys = [(10, 1996), (11, 1996), (12, 1995), (13, 1997), (14, 2000), (20, 1995), (500_003, 1996), (500_010, 1996), (500_020, 1999), (500_021, 2001)]
    rows = [(k, k % 7, "OFP"[k % 3], 1.5 * k, datetime.datetime(y, 3, 1), f"{k % 5}-LEVEL") for k, y in keys]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    queries, checks = catalogue.queries(), catalogue.checks()
    names = ["a1_normalise", "a2_normalisation_counts", "a5_source_summary", "a2_normalisation_counts_split_quoted", "a6_concatenate", "a7_typed_scan"]
    for name in names:
        got = queries[name](spark, str(tmp_path))
        want = sql.execute(checks[name])
        columns = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall()), name
