"""Cleaning and typing of raw loan columns (lazy projections, no shuffle unless noted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tranche import contracts
from tranche.functions import text
from tranche.functions.guards import ensure, not_null, require_columns
from tranche.functions.shape import record, rows_of
from tranche.operators.ordered import dense_positions

# Fixed values of the raw extract.
SENTINEL = 9999
PAYMENT_PLAN_CODES = {"n": 0, "y": 1}
LIST_STATUS_NAMES = {"w": "whole", "f": "fractional"}
UNCLEAR_HOME_OWNERSHIP = ["none", "any"]


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in dict.fromkeys(columns) if c in df.columns]


def with_row_ids(df: DataFrame, key: str, split: str = "split", name: str = "row_id") -> DataFrame:
    """Dense 1..n ids per split in the order of a unique business ``key``.

    Does nothing when the id exists. Numbers are given range by range, so no task sees a
    whole split; a repeated key, or a null key or split, fails the job.
    """
    if name in df.columns:
        return df
    df = df.withColumns({c: not_null(c) for c in (split, key)})
    ids = dense_positions(df, [split], key, name).select(
        split, key, ensure(F.col("n") == 1, F.col(name), F.concat(F.lit("repeated key: "), F.col(key).cast("string"))).alias(name)
    )
    return df.join(ids, [split, key]).select(name, *df.columns)


def sentinel(df: DataFrame, columns: Sequence[str], code: int = SENTINEL) -> DataFrame:
    """``has_<c>`` 0/1 flag, then nulls become ``code``. Refused when the flags exist already."""
    require_columns(df, *columns)
    done = [f"has_{c}" for c in columns if f"has_{c}" in df.columns]
    if done:
        raise ValueError(f"already encoded: {done}")
    flags = {f"has_{c}": F.col(c).isNotNull().cast("tinyint") for c in columns}
    filled = {c: F.coalesce(F.col(c), F.lit(code).cast(df.schema[c].dataType)) for c in columns}
    return df.withColumns({**flags, **filled})


def parse_months(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = ("MMM-yyyy", "MMM-yy")) -> DataFrame:
    return df.withColumns({c: text.month_start(F.col(c), tuple(formats)) for c in _present(df, columns)})


def percent_to_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: text.percent_to_double(F.col(c)) for c in _present(df, columns)})


def employment_years(df: DataFrame, column: str = "emp_length", output: str = "emp_length_years") -> DataFrame:
    if column not in df.columns:
        return df
    return df.withColumn(output, text.employment_years(F.col(column)))


def collapse_home_ownership(df: DataFrame, column: str = "home_ownership") -> DataFrame:
    if column not in df.columns:
        return df
    value = F.lower(text.strip(F.col(column)))
    return df.withColumn(column, F.when(value.isin(UNCLEAR_HOME_OWNERSHIP), F.lit("other")).otherwise(value))


def normalise_text(df: DataFrame, columns: Sequence[str], **switches: bool) -> DataFrame:
    return df.withColumns({c: text.normalise(F.col(c), **switches) for c in _present(df, columns)})


def map_values(
    df: DataFrame,
    column: str,
    mapping: dict,
    lowercase: bool = True,
    strip_whitespace: bool = True,
    output: str | None = None,
    allow_unmapped: bool = False,
) -> DataFrame:
    if column not in df.columns:
        return df
    value = F.col(column).cast("string")
    if strip_whitespace:
        value = text.strip(value)
    if lowercase:
        value = F.lower(value)
    return df.withColumn(output or column, text.lookup(value, mapping, allow_unmapped, what=column))


def term_months(df: DataFrame, column: str = "term", output: str = "term_months") -> DataFrame:
    return df.withColumn(output, text.first_integer(F.col(column)))


def category_space(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """(column_name, category, code, in_train, in_test): sorted union of the categories of both splits."""
    require_columns(df, *columns)
    seen = (
        df.select(split, *[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([split], list(columns), "column_name", "category")
        .filter(F.col("category").isNotNull())
        .groupBy("column_name", "category")
        .agg(
            F.max((F.col(split) == "train").cast("bigint")).alias("in_train"),
            F.max((F.col(split) == "test").cast("bigint")).alias("in_test"),
        )
    )
    codes = dense_positions(seen, ["column_name"], "category", "code").select("column_name", "category", "code")
    return seen.join(codes, ["column_name", "category"]).select("column_name", "category", "code", "in_train", "in_test")


def with_category_codes(df: DataFrame, space: DataFrame, column: str, output: str, most_inline: int = 1000) -> DataFrame:
    """Code of the row's category in the shared space.

    Up to ``most_inline`` categories become a constant of the plan, so rows are not shuffled by a few large categories;
    more are joined.
    """
    codes = space.filter(F.col("column_name") == column).select(
        F.col("category").alias(column), F.col("code").alias(output)
    )
    few = codes.limit(most_inline + 1).collect()
    if len(few) <= most_inline:
        table = F.create_map(*[F.lit(x) for r in few for x in (r[0], r[1])]) if few else F.lit(None).cast("map<string,bigint>")
        text = F.col(column).cast("string")
        return df.withColumns({column: text, output: F.when(text.isNotNull(), F.try_element_at(table, text))})
    return df.withColumn(column, F.col(column).cast("string")).join(codes, column, "left")


def align_numeric_types(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shared columns that are numeric on both sides with different types become double on both."""
    types = dict((f.name, f.dataType) for f in test.schema.fields)
    mixed = [
        f.name
        for f in train.schema.fields
        if f.name in types
        and isinstance(f.dataType, T.NumericType)
        and isinstance(types[f.name], T.NumericType)
        and f.dataType != types[f.name]
    ]
    cast = {c: F.col(c).cast("double") for c in mixed}
    return (train.withColumns(cast), test.withColumns(cast)) if cast else (train, test)


def drop_with_report(
    df: DataFrame, columns: Sequence[str], dataset_name: str, errors: str = "ignore"
) -> tuple[DataFrame, DataFrame]:
    """The frame without ``columns`` and a report (dataset_name, column_name, action, non_null)."""
    if errors not in ("ignore", "raise"):
        raise ValueError("errors must be 'ignore' or 'raise'")
    wanted = list(dict.fromkeys(columns))
    missing = [c for c in wanted if c not in df.columns]
    if missing and errors == "raise":
        raise KeyError(f"columns not found: {missing}")
    counts = df.agg(*[(F.count(F.col(c)) if c in df.columns else F.lit(0).cast("bigint")).alias(c) for c in wanted])
    report = rows_of(
        counts,
        [],
        [
            record(
                dataset_name=dataset_name,
                column_name=c,
                action="missing" if c in missing else "dropped",
                non_null=F.col(c),
            )
            for c in wanted
        ],
    )
    return df.drop(*[c for c in wanted if c not in missing]), report


def project_layer(df: DataFrame, excluded: Sequence[str], benchmark: Sequence[str]) -> DataFrame:
    """Clean layer -> feature base: everything but the excluded and the benchmark columns."""
    gone = set(excluded) | set(benchmark)
    return df.select(*[c for c in df.columns if c not in gone])


def same_types(train: DataFrame, test: DataFrame) -> None:
    a, b = dict(train.dtypes), dict(test.dtypes)
    wrong = {c: (a[c], b[c]) for c in a if c in b and a[c] != b[c]}
    if wrong:
        raise contracts.ContractViolation(f"types differ: {wrong}")


def checkpoint_metrics(
    df: DataFrame, dataset_name: str, checkpoint_name: str, id_column: str | None = None, extra: dict | None = None
) -> DataFrame:
    """One row: rows, columns, id presence, id nulls, id uniqueness and any extra metrics."""
    has_id = id_column is not None and id_column in df.columns
    extra = extra or {}
    if has_id:
        per_id = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("_n"), *[e.alias(k) for k, e in extra.items()])
        folded = per_id.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col(id_column).isNull(), F.col("_n"))), F.lit(0)).alias("id_nulls"),
            F.coalesce(F.max("_n") <= 1, F.lit(True)).alias("id_unique"),
            *[F.sum(k).alias(k) for k in extra],
        )
    else:
        folded = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.lit(None).cast("bigint").alias("id_nulls"),
            F.lit(None).cast("boolean").alias("id_unique"),
            *[e.alias(k) for k, e in extra.items()],
        )
    return folded.select(
        F.lit(checkpoint_name).alias("checkpoint_name"),
        F.lit(dataset_name).alias("dataset_name"),
        "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(has_id).alias("id_present"),
        "id_nulls",
        "id_unique",
        *extra,
    )
