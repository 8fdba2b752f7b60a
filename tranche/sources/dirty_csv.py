"""Ingest of CSV extracts with prospectus lines, repeated headers, blank rows and footers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tranche.contracts import ContractViolation, same_columns
from tranche.functions.guards import require_columns
from tranche.plans.session import written_once

# Text between quotes, in a line.
QUOTED = '"[^"]*"'
# A line whose last cell starts with a quote and doesn't close it; and text between quotes or after the last open one.
LEFT_OPEN = '^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|(?!")[^,]*+),)*+"[^"]*+(?:""[^"]*+)*+$'
OPEN_OR_QUOTED = '"[^"]*("|$)'
# Lines of a file that are looked at first for its header.
HEAD_LINES = 64
PREVIEW_LINES = 8
PREVIEW_WIDTH = 250
ROW_CLASSES = ["data", "header", "non_tabular", "blank"]


def text_lines(spark: SparkSession, path: str | Sequence[str], source: str | None = None) -> DataFrame:
    """(source_file, file, block, line_id, value): physical lines with an order inside each file.

    ``source`` names a partition column that identifies the source; otherwise it is the file name.
    Line ids rise within a block of a file, and blocks are ordered by their offset.
    """
    lines = spark.read.text(path).withColumns(
        {
            "file": F.col("_metadata.file_path"),
            "block": F.col("_metadata.file_block_start"),
            "line_id": F.monotonically_increasing_id(),
        }
    )
    name = F.col(source).cast("string") if source else F.col("_metadata.file_name")
    return lines.select(name.alias("source_file"), "file", "block", "line_id", "value")


def preview(spark: SparkSession, path: str | Sequence[str], source: str | None = None, lines: int = PREVIEW_LINES) -> DataFrame:
    """First and last lines per file, cut to a fixed width, numbered from 0.

    Both ends are rank filters, so each task passes on only its own few candidates.
    """
    rows = text_lines(spark, path, source)
    keys = ["source_file", "file"]
    forward = W.partitionBy(*keys).orderBy("block", "line_id")
    backward = W.partitionBy(*keys).orderBy(F.desc("block"), F.desc("line_id"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    head = (
        rows.withColumn("rank", F.row_number().over(forward))
        .filter(F.col("rank") <= lines)
        .select(*keys, F.lit("head").alias("section"), (F.col("rank") - 1).cast("bigint").alias("line_number"), "value")
    )
    tail = (
        rows.withColumn("rank", F.row_number().over(backward))
        .filter(F.col("rank") <= lines)
        .join(sizes, keys)
        .select(*keys, F.lit("tail").alias("section"), (F.col("size") - F.col("rank")).alias("line_number"), "value")
    )
    return (
        head.unionByName(tail)
        .select("source_file", "section", "line_number", F.substring("value", 1, PREVIEW_WIDTH).alias("preview"))
        .orderBy("source_file", "section", "line_number")
    )


def first_tabular_lines(
    spark: SparkSession, path: str | Sequence[str], source: str | None = None, quoted_newlines: bool = True
) -> DataFrame:
    """(source_file, file, header): cell names of the first record with more than one cell, per file.

    A comma between quotes separates nothing, so a quoted sentence is one cell. With quoted newlines a record goes on
    over the lines of a cell left open, so the first row of a file without a header is read whole.
    """
    bare = F.regexp_replace("value", QUOTED, "")
    lines = text_lines(spark, path, source)
    if quoted_newlines:
        found = _first_tabular_records(lines)
    else:
        first = F.row_number().over(W.partitionBy("source_file", "file").orderBy("block", "line_id"))
        found = lines.filter(bare.contains(",")).withColumn("rank", first).filter(F.col("rank") == 1)
    # Quoted cells are kept whole: a comma counts where an even number of quotes follows it.
    cells = F.split(F.trim("value"), r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    plain = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')))
    return found.select("source_file", "file", plain.alias("header"))


def _first_tabular_records(lines: DataFrame) -> DataFrame:
    """(source_file, file, value): the first record with more than one cell, per file that has one.

    Only the first lines of a file are gathered. Files whose first tabular record ends later are read again with more
    lines, until it is found or the file ends; only their paths come to the driver.
    """
    keys = ["source_file", "file"]
    in_order = W.partitionBy(*keys).orderBy("block", "line_id")
    found, size, left = [], HEAD_LINES, None
    while left is None or left:
        rows = lines.filter(F.col("file").isin(left)) if left else lines
        # One line more than is looked at tells whether the file goes on.
        head = rows.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= size + 1)
        gathered = head.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("all"))
        more = F.size("all") > size
        ends = gathered.select(*keys, more.alias("more"), F.slice(F.transform("all", lambda x: x["value"]), 1, size).alias("lines"))
        looked = written_once(ends.select(*keys, "more", _first_tabular_record("lines").alias("value")), "csv-heads")
        found.append(looked.filter(F.col("value").isNotNull()).select(*keys, "value"))
        left = [r.file for r in looked.filter(F.col("value").isNull() & F.col("more")).select("file").collect()]
        size *= HEAD_LINES
    return reduce(DataFrame.unionByName, found)


def _first_tabular_record(lines: str) -> Column:
    """The first record with more than one cell of an array of lines; a cell left open goes on in the next line.

    A record that the array cuts short is not taken, unless the array ends the file (``more`` is false).
    """
    number = F.lit(None).cast("int")
    start = F.struct(
        F.lit(0).alias("i"), F.lit(False).alias("open"), F.lit(0).alias("start"), F.lit(False).alias("tabular"),
        number.alias("first"), number.alias("last"),
    )

    def step(s: Column, line: Column) -> Column:
        # A line inside a quoted cell is what follows the opening quote.
        text = F.when(s["open"], F.concat(F.lit('"'), line)).otherwise(line)
        opens = text.rlike(LEFT_OPEN)
        comma = F.when(opens, F.regexp_replace(text, OPEN_OR_QUOTED, "")).otherwise(F.regexp_replace(text, QUOTED, "")).contains(",")
        tabular = (s["open"] & s["tabular"]) | comma
        begin = F.when(s["open"], s["start"]).otherwise(s["i"])
        ends = s["last"].isNull() & ~opens & tabular
        return F.struct(
            (s["i"] + 1).alias("i"), opens.alias("open"), begin.alias("start"), tabular.alias("tabular"),
            F.when(ends, begin).otherwise(s["first"]).alias("first"), F.when(ends, s["i"]).otherwise(s["last"]).alias("last"),
        )

    def record(s: Column) -> Column:
        # A quote left open runs to the end of the file.
        runs_out = s["last"].isNull() & s["open"] & s["tabular"] & ~F.col("more")
        first, last = F.when(runs_out, s["start"]).otherwise(s["first"]), F.when(runs_out, s["i"] - 1).otherwise(s["last"])
        return F.when(last.isNotNull(), F.array_join(F.slice(F.col(lines), first + 1, last - first + 1), "\n"))

    return F.aggregate(F.col(lines), start, step, record)


def header_consistency(
    spark: SparkSession, path: str | Sequence[str], source: str | None = None, quoted_newlines: bool = True
) -> DataFrame:
    """Whether each file has the reference header, in its order."""
    expected = F.array(*[F.lit(name) for name in read_header(spark, path, source, quoted_newlines)])
    return (
        first_tabular_lines(spark, path, source, quoted_newlines)
        .groupBy("source_file")
        .agg(F.min(F.col("header").eqNullSafe(expected)).alias("matches_reference_schema"))
        .orderBy("source_file")
    )


def read_header(
    spark: SparkSession, path: str | Sequence[str], source: str | None = None, quoted_newlines: bool = True
) -> list[str]:
    """The reference header: the first tabular record that most files share, of equals that of the first source.

    A record with a number, an empty cell or a name twice is a header only where no file has a better one.
    """
    cell = F.col("header")
    odd = F.exists(cell, lambda c: c.try_cast("double").isNotNull() | (c == "")) | (F.size(F.array_distinct(cell)) < F.size(cell))
    shared = first_tabular_lines(spark, path, source, quoted_newlines).groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("at"))
    row = shared.agg(F.min_by("header", F.struct(odd, -F.col("n"), "at")).alias("h")).first()
    if row is None or row.h is None:
        raise ValueError("no line with more than one cell")
    return list(row.h)


def other_layouts(
    spark: SparkSession, path: str | Sequence[str], header: Sequence[str], source: str | None = None, quoted_newlines: bool = True
) -> list[tuple[list[str], list[str]]]:
    """(columns in the file's order, files) for files that don't start with the reference header.

    The same names in another order are that order; as many cells of which none is a name are a file without a header. Files that
    disagree otherwise fail the call. Only the paths of such files come to the driver.
    """
    expected = F.array(*[F.lit(name) for name in header])
    rest = first_tabular_lines(spark, path, source, quoted_newlines).filter(~F.col("header").eqNullSafe(expected))
    reordered = F.array_sort("header").eqNullSafe(F.array_sort(expected))
    headless = (F.size("header") == len(header)) & ~F.arrays_overlap("header", expected)
    order = F.when(reordered, F.col("header")).when(headless, expected)
    groups = rest.groupBy(order.alias("order")).agg(F.collect_list("file").alias("files"), F.min("source_file").alias("first")).collect()
    for g in groups:
        if g.order is None:
            raise ContractViolation(f"{len(g.files)} files have other columns than {list(header)}; the first is of {g.first}")
    return [(list(g.order), sorted(g.files)) for g in groups]


def records(spark: SparkSession, path: str | Sequence[str], source: str | None = None) -> DataFrame:
    """(source_file, file, block, line_id, record): CSV records whose quoted cells may hold line breaks, read in parallel.

    Lines are read as text, as many tasks to a file as it has blocks. A line starts a record where the quotes before
    it are even in number: quotes are counted per block, the few block sums are carried along the file, and only a
    block's own lines are ordered together. A line inside quotes joins the last record started before it, which may
    lie in an earlier block; that start is carried from block to block the same way. The lines of a record are then
    grouped by its first line and joined by a line feed (a carriage return before a break is not kept). Empty lines
    outside quotes are no record, as the CSV reader skips them (``empty_lines`` counts them); lines of blanks are. A quote left open runs to the
    end of its file, as with the reader.
    """
    # Line ids are numbered once and written: branches of one plan may deal files to tasks differently, and would number them anew.
    rows = written_once(text_lines(spark, path, source), "csv-lines")
    block = ["source_file", "file", "block"]
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    rows = rows.withColumn("quotes", quotes)
    earlier = W.partitionBy("source_file", "file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*block).orderBy("line_id").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*block).agg(F.sum("quotes").alias("q"))
    offsets = sums.select(*block, F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("offset"))
    rows = rows.join(offsets, block).withColumn("starts", (F.col("offset") + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2 == 0)
    # The last start of each block, carried to the blocks after it; a block's first lines inside quotes take it.
    start = F.when(F.col("starts"), F.struct(F.col("block").alias("b"), F.col("line_id").alias("l")))
    last_of_block = rows.groupBy(*block).agg(F.max(start).alias("last"))
    carried = last_of_block.select(*block, F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    upto = W.partitionBy(*block).orderBy("line_id").rowsBetween(W.unboundedPreceding, 0)
    keyed = rows.join(carried, block).withColumn("at", F.coalesce(F.last(start, ignorenulls=True).over(upto), F.col("carried")))
    kept = keyed.where(~F.col("starts") | (F.col("value") != ""))
    grouped = kept.groupBy("source_file", "file", "at").agg(F.sort_array(F.collect_list(F.struct("block", "line_id", "value"))).alias("lines"))
    return grouped.select(
        "source_file", "file", F.col("at.b").alias("block"), F.col("at.l").alias("line_id"),
        F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"),
    )


def classified_rows(
    spark: SparkSession,
    path: str | Sequence[str],
    header: Sequence[str],
    source: str | None = None,
    quoted_newlines: bool = True,
    files: Sequence[str] | None = None,
    split_quoted: bool = False,
) -> DataFrame:
    """Every record with its class: data, header, non_tabular or blank. ``files`` picks some of those below ``path``.

    All cells are read as text; records of another arity land in the corrupt-record column.
    Spark's reader cannot split files with quoted newlines; pass False for files without them and
    each file is read by as many tasks as it has blocks. ``split_quoted`` reads such files in
    parallel all the same: records are put together by ``records`` and parsed one by one.
    """
    names = [f"_c{i}" for i in range(len(header))]
    schema = ", ".join(f"{n} string" for n in names) + ", _bad string"
    if split_quoted and quoted_newlines:
        return _classified(_parsed_records(spark, path, schema, source, files), header, names)
    if source:
        schema += f", {source} string"
    reader = (
        spark.read.schema(schema)
        .option("header", False)
        .option("multiLine", quoted_newlines)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("enforceSchema", True)
    )
    # The file metadata is selected at the read, where it is available.
    if files and source and isinstance(path, str):
        reader = reader.option("basePath", path)
    rows = reader.csv(list(files) if files else path)
    name = F.col(source).cast("string") if source else F.col("_metadata.file_name")
    return _classified(rows.select(name.alias("source_file"), F.col("_metadata.file_path").alias("file"), *names, "_bad"), header, names)


def _parsed_records(spark: SparkSession, path, schema: str, source: str | None, files: Sequence[str] | None = None) -> DataFrame:
    """(source_file, file, cells..., _bad) of the records put together from lines, parsed as the CSV reader parses."""
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    found = records(spark, path, source)
    if files:
        found = found.filter(F.col("file").isin(list(files)))
    return found.select("source_file", "file", F.from_csv("record", schema, options).alias("r")).select("source_file", "file", "r.*")


def _classified(rows: DataFrame, header: Sequence[str], names: Sequence[str]) -> DataFrame:
    cells = F.array(*names)
    no_cell = ~F.exists(cells, lambda c: c.isNotNull() & (F.trim(c) != ""))
    blank = F.when(F.col("_bad").isNull(), no_cell).otherwise(F.col("_bad").rlike(r'^[\s,"]*$'))
    row_class = (
        F.when(blank, "blank")
        .when(F.col("_bad").isNotNull(), "non_tabular")
        .when(cells == F.array(*[F.lit(h) for h in header]), "header")
        .otherwise("data")
    )
    return rows.select("source_file", "file", row_class.alias("row_class"), *names)


def _by_layout(spark, path, header, source, quoted_newlines, split_quoted=False) -> list[tuple[Sequence[str], DataFrame]]:
    """The classified rows of the files with the reference layout, then those of each other layout."""
    others = other_layouts(spark, path, header, source, quoted_newlines)
    odd = [f for _, files in others for f in files]
    usual = classified_rows(spark, path, header, source, quoted_newlines, split_quoted=split_quoted)
    parts = [(header, usual.filter(~F.col("file").isin(odd)) if odd else usual)]
    return parts + [(order, classified_rows(spark, path, order, source, quoted_newlines, files, split_quoted)) for order, files in others]


def normalise(
    spark: SparkSession,
    path: str | Sequence[str],
    header: Sequence[str] | None = None,
    source: str | None = None,
    quoted_newlines: bool = True,
    split_quoted: bool = False,
) -> DataFrame:
    """Tabular rows of the files as text columns named by the header, with ``source_file``.

    Each file is read by its own header, or by the reference header where it has none. ``split_quoted``: files
    with quoted newlines are read by many tasks each (see ``records``).
    """
    header = list(header) if header else read_header(spark, path, source, quoted_newlines)
    parts = [
        rows.filter(F.col("row_class") == "data").select("source_file", *[F.col(f"_c{order.index(h)}").alias(h) for h in header])
        for order, rows in _by_layout(spark, path, header, source, quoted_newlines, split_quoted)
    ]
    return reduce(DataFrame.unionByName, parts)


def empty_lines(spark: SparkSession, path: str | Sequence[str], source: str | None = None, quoted_newlines: bool = True) -> DataFrame:
    """(source_file, file_count, empty_lines): lines without any character, which the CSV reader swallows.

    With quoted newlines a line inside quotes is no record; the number of quotes before it tells.
    Quotes are summed per block of a file, the few block sums are added up along the file, and only
    the lines of one block are ordered together.
    """
    rows = text_lines(spark, path, source)
    is_empty = F.col("value") == ""
    if quoted_newlines:
        block = ["source_file", "file", "block"]
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        rows = rows.select(*block, "line_id", is_empty.alias("is_empty"), quotes.alias("quotes"))
        earlier = W.partitionBy("source_file", "file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        offsets = rows.groupBy(*block).agg(F.sum("quotes").alias("q")).select(
            *block, F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("offset")
        )
        before = W.partitionBy(*block).orderBy("line_id").rowsBetween(W.unboundedPreceding, -1)
        open_quotes = (F.col("offset") + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2
        rows = rows.join(offsets, block).withColumn("open", open_quotes)
        is_empty = F.col("is_empty") & (F.col("open") == 0)
    per_file = rows.groupBy("source_file", "file").agg(F.count_if(is_empty).alias("empty"))
    return per_file.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("empty").alias("empty_lines")
    )


def normalisation_counts(
    spark: SparkSession,
    path: str | Sequence[str],
    header: Sequence[str] | None = None,
    source: str | None = None,
    quoted_newlines: bool = True,
    split_quoted: bool = False,
) -> DataFrame:
    """Rows seen, staged (with the one header of a file that has one) and removed, per source."""
    header = list(header) if header else read_header(spark, path, source, quoted_newlines)
    layouts = _by_layout(spark, path, header, source, quoted_newlines, split_quoted)
    parts = [rows.select("source_file", "file", "row_class") for _, rows in layouts]
    per_file = reduce(DataFrame.unionByName, parts).groupBy("source_file", "file").agg(
        *[F.count_if(F.col("row_class") == c).alias(c) for c in ROW_CLASSES]
    )
    counted = per_file.groupBy("source_file").agg(
        *[F.sum(c).alias(c) for c in ROW_CLASSES], F.sum(F.least("header", F.lit(1))).alias("own_headers")
    )
    joined = counted.join(empty_lines(spark, path, source, quoted_newlines), "source_file")
    seen: Column = sum((F.col(c) for c in ROW_CLASSES), F.col("empty_lines"))
    return joined.select(
        "source_file",
        seen.alias("source_row_count"),
        (F.col("data") + F.col("own_headers")).alias("staged_row_count"),
        F.col("non_tabular").alias("removed_non_tabular_row_count"),
        (F.col("header") - F.col("own_headers")).alias("removed_repeated_header_row_count"),
        (F.col("blank") + F.col("empty_lines")).alias("removed_blank_row_count"),
    ).orderBy("source_file")


def source_summary(staged: DataFrame, id_column: str = "id", source: str = "source_file") -> DataFrame:
    """Rows, columns and distinct ids per source (ids are counted once before they are counted per source)."""
    require_columns(staged, source, id_column)
    columns = len([c for c in staged.columns if c != source])
    per_id = staged.groupBy(source, id_column).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_id.groupBy(source)
        .agg(F.sum("n").alias("row_count"), F.count(id_column).alias("unique_id_count"))
        .select(source, "row_count", F.lit(columns).cast("bigint").alias("column_count"), "unique_id_count")
        .orderBy(source)
    )


def concatenate(train_parts: Sequence[DataFrame], test_parts: Sequence[DataFrame]) -> DataFrame:
    """One frame with a ``split`` column from the staged parts of both splits."""
    result = None
    for label, parts in (("train", train_parts), ("test", test_parts)):
        for p in parts:
            labelled = p.withColumn("split", F.lit(label))
            if result is not None:
                same_columns(result, labelled)
            result = labelled if result is None else result.unionByName(labelled)
    if result is None:
        raise ValueError("nothing to concatenate")
    return result


def concatenation_summary(raw: DataFrame) -> DataFrame:
    columns = len([c for c in raw.columns if c != "split"])
    return raw.groupBy("split").agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(columns).cast("bigint")
    )


def inferred_types(df: DataFrame) -> DataFrame:
    """(column_name, inferred_type): bigint, double or string by what every non-null text parses as.

    One aggregate over all text columns; a column without values counts as double, as an empty
    numeric column does.
    """
    from tranche.functions.shape import record, rows_of

    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        raise ValueError("no text columns to infer")
    aggs, records = [], []
    for i, c in enumerate(texts):
        v = F.trim(F.col(c))
        whole = v.rlike(r"^[+-]?\d+$") & v.try_cast("bigint").isNotNull()
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(whole).alias(f"w{i}"),
            F.count(v.try_cast("double")).alias(f"d{i}"),
        ]
        n, w, d = F.col(f"n{i}"), F.col(f"w{i}"), F.col(f"d{i}")
        kind = F.when(n == 0, "double").when(w == n, "bigint").when(d == n, "double").otherwise("string")
        records.append(record(column_name=c, inferred_type=kind))
    return rows_of(df.agg(*aggs), [], records)


def with_inferred_types(df: DataFrame) -> DataFrame:
    """Cast text columns to their inferred types (fits one type name per column first)."""
    types = {r.column_name: r.inferred_type for r in inferred_types(df).collect()}
    return df.withColumns({c: F.trim(F.col(c)).cast(t) for c, t in types.items() if t != "string"})
