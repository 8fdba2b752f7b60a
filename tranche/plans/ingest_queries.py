"""Catalogue: sources and sinks (A). Dirty CSV files are written from the orders table and read back.

One source file holds the orders of one year and one key block, so files stay of bounded size
however many orders there are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tranche.functions.shape import record
from tranche.operators import drift
from tranche.plans.audit_frames import audit_test, audit_train
from tranche.plans.audit_queries import ALIGNED_NUMBERS, ALIGNED_STRINGS, TOP_NUMBERS, number_select
from tranche.plans.loans import clean_loans, raw_loans, table
from tranche.plans.registry import check, query, r, rounded
from tranche.plans.session import shared_folder
from tranche.sources import dirty_csv, reports, storage

HEADER = ["id", "cust", "status", "note"]
# The rows that do not belong to the table, by their place in the file.
PROSPECTUS = '"Notes, offered by Prospectus"'
# The year whose files have their columns in another order, and the year whose files have no header.
REORDERED_YEAR, HEADLESS_YEAR = 1995, 1996
REORDERED = ["note", "cust", "id", "status"]
FOOTER = "Total amount funded in policy code 1"
BLOCK = 500_000
SOURCE = "CAST(YEAR(o_orderdate) AS VARCHAR) || '_' || CAST(o_orderkey // 500000 AS VARCHAR)"


def _head(names) -> str:
    return ",".join(f'"{h}"' for h in names)


def write_dirty_orders(spark, sf_dir, line_breaks: bool = True) -> str:
    """Text files with preamble, header, repeated header, blank, short and long rows, and a footer.

    One year's files have their columns in another order, and another year's have no header.
    """
    orders = table(spark, sf_dir, "orders").withColumn(
        "source", F.concat_ws("_", F.year("o_orderdate").cast("string"), F.floor(F.col("o_orderkey") / BLOCK).cast("string"))
    )
    key = F.col("o_orderkey")
    quoted = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', ""late""'), F.lit("\nnext line" if line_breaks else ""), F.lit('"'))
    cells = {
        "id": key.cast("string"),
        "cust": F.col("o_custkey").cast("string"),
        "status": F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')),
        "note": F.when(key % 10 == 0, quoted).otherwise(F.col("o_orderpriority")),
    }
    year = F.year("o_orderdate")
    in_order = lambda names: F.concat_ws(",", *[cells[c] for c in names])
    line = F.when(year == REORDERED_YEAR, in_order(REORDERED)).otherwise(in_order(HEADER))
    data = orders.select("source", (key * 10 + 100).alias("place"), line.alias("value"))
    head = F.when(F.col("year") == REORDERED_YEAR, _head(REORDERED)).when(F.col("year") != HEADLESS_YEAR, _head(HEADER))
    first, last = F.col("first"), F.col("last")
    extra = F.array(
        record(place=F.lit(0).cast("bigint"), value=PROSPECTUS),
        record(place=F.lit(1).cast("bigint"), value=head),
        record(place=first * 10 + 101, value=head),
        record(place=first * 10 + 102, value=""),
        record(place=first * 10 + 103, value=",,,"),
        record(place=first * 10 + 104, value=",,"),
        record(place=first * 10 + 105, value="1,2"),
        record(place=first * 10 + 106, value="1,2,3,4,5"),
        record(place=last * 10 + 109, value=FOOTER),
    )
    noise = (
        orders.groupBy("source")
        .agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.min(year).alias("year"))
        .select("source", F.inline(extra))
        .filter(F.col("value").isNotNull())
    )
    path = shared_folder(spark, "dirty")
    (
        data.unionByName(noise)
        .repartition("source")
        .sortWithinPartitions("source", "place")
        .select("source", "value")
        .write.partitionBy("source")
        .text(path)
    )
    return path


@query(
    "a1_normalise",
    f"""SELECT {SOURCE} AS source_file, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status,
        CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority || ', "late"' || chr(10) || 'next line' ELSE o_orderpriority END AS note FROM orders""",
)
def a1_normalise(spark, sf_dir):
    return dirty_csv.normalise(spark, write_dirty_orders(spark, sf_dir), source="source")


@query(
    "a1_normalise_splittable",
    f"""SELECT {SOURCE} AS source_file, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status,
        CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority || ', "late"' ELSE o_orderpriority END AS note FROM orders""",
)
def a1_normalise_splittable(spark, sf_dir):
    path = write_dirty_orders(spark, sf_dir, line_breaks=False)
    return dirty_csv.normalise(spark, path, source="source", quoted_newlines=False)


@query(
    "a2_normalisation_counts",
    f"""SELECT source_file, n + 7 + 2 * h AS source_row_count, n + h AS staged_row_count,
        CAST(4 AS BIGINT) AS removed_non_tabular_row_count, h AS removed_repeated_header_row_count,
        CAST(3 AS BIGINT) AS removed_blank_row_count FROM (
        SELECT {SOURCE} AS source_file, COUNT(*) AS n, CAST(MAX(YEAR(o_orderdate)) <> {HEADLESS_YEAR} AS BIGINT) AS h FROM orders GROUP BY 1)""",
)
def a2_normalisation_counts(spark, sf_dir):
    return dirty_csv.normalisation_counts(spark, write_dirty_orders(spark, sf_dir), source="source")


@query("a1_normalise_split_quoted", f"""SELECT {SOURCE} AS source_file, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status,
        CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority || ', "late"' || chr(10) || 'next line' ELSE o_orderpriority END AS note FROM orders""")
def a1_normalise_split_quoted(spark, sf_dir):
    """The same files with quoted line breaks as a1, read by many tasks a file: records put together from lines."""
    return dirty_csv.normalise(spark, write_dirty_orders(spark, sf_dir), source="source", split_quoted=True)


@query("a2_normalisation_counts_split_quoted", f"""SELECT source_file, n + 7 + 2 * h AS source_row_count, n + h AS staged_row_count,
        CAST(4 AS BIGINT) AS removed_non_tabular_row_count, h AS removed_repeated_header_row_count,
        CAST(3 AS BIGINT) AS removed_blank_row_count FROM (
        SELECT {SOURCE} AS source_file, COUNT(*) AS n, CAST(MAX(YEAR(o_orderdate)) <> {HEADLESS_YEAR} AS BIGINT) AS h FROM orders GROUP BY 1)""")
def a2_normalisation_counts_split_quoted(spark, sf_dir):
    return dirty_csv.normalisation_counts(spark, write_dirty_orders(spark, sf_dir), source="source", split_quoted=True)


_NOTE = '''CASE WHEN o_orderkey % 10 = 0 THEN '"' || o_orderpriority || ', ""late""' || '"' ELSE o_orderpriority END'''
_LINE = f'''CASE WHEN YEAR(o_orderdate) = {REORDERED_YEAR}
    THEN {_NOTE} || ',' || o_custkey || ',' || o_orderkey || ',"' || o_orderstatus || '"'
    ELSE o_orderkey || ',' || o_custkey || ',"' || o_orderstatus || '",' || {_NOTE} END'''
_HEAD = f"CASE WHEN y = {REORDERED_YEAR} THEN '{_head(REORDERED)}' ELSE '{_head(HEADER)}' END"


@query(
    "a3_preview",
    f"""WITH o AS (SELECT {SOURCE} AS source_file, o_orderkey * 10 + 100 AS place, {_LINE} AS line, o_orderkey, YEAR(o_orderdate) AS y FROM orders),
        e AS (SELECT source_file, MIN(o_orderkey) * 10 AS f, MAX(o_orderkey) * 10 AS l, MAX(y) AS y FROM o GROUP BY 1),
        lines AS (SELECT source_file, place, line FROM o
          UNION ALL SELECT source_file, 0, '{PROSPECTUS}' FROM e UNION ALL SELECT source_file, 1, {_HEAD} FROM e WHERE y <> {HEADLESS_YEAR}
          UNION ALL SELECT source_file, f + 101, {_HEAD} FROM e WHERE y <> {HEADLESS_YEAR} UNION ALL SELECT source_file, f + 102, '' FROM e
          UNION ALL SELECT source_file, f + 103, ',,,' FROM e UNION ALL SELECT source_file, f + 104, ',,' FROM e
          UNION ALL SELECT source_file, f + 105, '1,2' FROM e UNION ALL SELECT source_file, f + 106, '1,2,3,4,5' FROM e
          UNION ALL SELECT source_file, l + 109, '{FOOTER}' FROM e),
        numbered AS (SELECT source_file, line, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY place) - 1 AS line_number,
          COUNT(*) OVER (PARTITION BY source_file) AS size FROM lines)
        SELECT source_file, 'head' AS section, line_number, line[1:250] AS preview FROM numbered WHERE line_number < 8
        UNION ALL SELECT source_file, 'tail', line_number, line[1:250] FROM numbered WHERE line_number >= size - 8""",
)
def a3_preview(spark, sf_dir):
    return dirty_csv.preview(spark, write_dirty_orders(spark, sf_dir, line_breaks=False), source="source")


@query("a4_header_consistency", f"SELECT DISTINCT {SOURCE} AS source_file, YEAR(o_orderdate) NOT IN ({REORDERED_YEAR}, {HEADLESS_YEAR}) AS matches_reference_schema FROM orders")
def a4_header_consistency(spark, sf_dir):
    return dirty_csv.header_consistency(spark, write_dirty_orders(spark, sf_dir), source="source")


@query(
    "a5_source_summary",
    f"""SELECT {SOURCE} AS source_file, COUNT(*) AS row_count, CAST(4 AS BIGINT) AS column_count,
        COUNT(DISTINCT o_orderkey) AS unique_id_count FROM orders GROUP BY 1""",
)
def a5_source_summary(spark, sf_dir):
    return dirty_csv.source_summary(dirty_csv.normalise(spark, write_dirty_orders(spark, sf_dir), HEADER, "source"))


@query(
    "a6_concatenate",
    """SELECT CASE WHEN YEAR(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS split, COUNT(*) AS row_count,
       CAST(4 AS BIGINT) AS column_count FROM orders GROUP BY 1""",
)
def a6_concatenate(spark, sf_dir):
    staged = dirty_csv.normalise(spark, write_dirty_orders(spark, sf_dir), HEADER, "source")
    year = F.substring("source_file", 1, 4).cast("int")
    parts = [staged.filter(year < 1998), staged.filter(year.between(1998, 1999)), staged.filter(year >= 2000)]
    raw = dirty_csv.concatenate([p.drop("source_file") for p in parts[:2]], [parts[2].drop("source_file")])
    return dirty_csv.concatenation_summary(raw)


@query(
    "a7_inferred_types",
    """SELECT column_name, CASE column_name WHEN 'id' THEN 'bigint' WHEN 'cust' THEN 'bigint' ELSE 'string' END AS inferred_type
       FROM (VALUES ('id'), ('cust'), ('status'), ('note')) t(column_name) WHERE (SELECT COUNT(*) FROM orders) > 0""",
)
def a7_inferred_types(spark, sf_dir):
    staged = dirty_csv.normalise(spark, write_dirty_orders(spark, sf_dir), HEADER, "source")
    return dirty_csv.inferred_types(staged.drop("source_file"))


@query("a7_typed_scan", "SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status FROM orders")
def a7_typed_scan(spark, sf_dir):
    staged = dirty_csv.normalise(spark, write_dirty_orders(spark, sf_dir), HEADER, "source")
    return dirty_csv.with_inferred_types(staged.select("id", "cust", "status"))


def _typed(df):
    """Counts come back from CSV as the narrowest integer; compare them as bigint."""
    return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t == "int"})


_ROUND_TRIP = ["row_id", "split", "loan_amnt", "annual_inc", "purpose", "dti", "issue_year"]


@query("a8_csv_round_trip", check(f"SELECT {', '.join(_ROUND_TRIP)} FROM clean"))
def a8_csv_round_trip(spark, sf_dir):
    clean = clean_loans(raw_loans(spark, sf_dir)).select(*_ROUND_TRIP)
    path = shared_folder(spark, "csv")
    storage.write_csv(clean, path)
    return storage.read_csv(spark, path, ", ".join(f"{c} {t}" for c, t in clean.dtypes))


@query("a9_layer_round_trip", check(f"SELECT {', '.join(_ROUND_TRIP)} FROM clean WHERE split = 'test'"))
def a9_layer_round_trip(spark, sf_dir):
    path = shared_folder(spark, "layer")
    storage.write_layer(clean_loans(raw_loans(spark, sf_dir)).select(*_ROUND_TRIP), path)
    return storage.read_layer(spark, path, "test").select(*_ROUND_TRIP)


_JSON = """CASE WHEN {c} = '' THEN '[]' WHEN {c} IS NOT NULL THEN '["' || REPLACE({c}, '|', '","') || '"]' END AS {c}"""


@query(
    "a10_string_report_export",
    check(
        f"""SELECT * REPLACE ({r('null_gap_test_minus_train')} AS null_gap_test_minus_train,
            {_JSON.format(c='sample_values_train')}, {_JSON.format(c='sample_values_test')}) FROM aligned WHERE has_difference""",
        *ALIGNED_STRINGS,
    ),
)
def a10_string_report_export(spark, sf_dir):
    folder = shared_folder(spark, "reports")
    drift.string_drift_report(audit_train(spark, sf_dir), audit_test(spark, sf_dir), export_dir=folder, tag="raw")
    return rounded(_typed(storage.read_csv(spark, reports.report_path(folder, "string_alignment", "raw", "deltas"))))


@query("a11_numeric_report_export", check(number_select() + TOP_NUMBERS + " LIMIT 10", *ALIGNED_NUMBERS))
def a11_numeric_report_export(spark, sf_dir):
    folder = shared_folder(spark, "reports")
    drift.numeric_drift_report(audit_train(spark, sf_dir), audit_test(spark, sf_dir), export_dir=folder, tag="clean")
    return rounded(_typed(storage.read_csv(spark, reports.report_path(folder, "numerical_alignment", "clean", "top_deltas"))))


@query(
    "a13_arrays_as_json",
    check(
        """SELECT home_ownership, to_json(list_sort(list(DISTINCT grade)))::VARCHAR AS grades FROM clean GROUP BY home_ownership"""
    ),
)
def a13_arrays_as_json(spark, sf_dir):
    clean = clean_loans(raw_loans(spark, sf_dir))
    pairs = clean.groupBy("home_ownership", "grade").agg(F.count(F.lit(1)).alias("n"))
    lists = pairs.groupBy("home_ownership").agg(F.array_sort(F.collect_list("grade")).alias("grades"))
    return reports.arrays_as_json(lists)
