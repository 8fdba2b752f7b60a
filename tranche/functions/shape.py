"""Helpers for small tables: wide rows made long, fitted values made local."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def record(**fields) -> Column:
    """Struct with the given field names; plain values become literals."""
    parts: list[Column] = []
    for name, value in fields.items():
        parts += [F.lit(name), _as_column(value)]
    return F.named_struct(*parts)


def rows_of(df: DataFrame, keep: Sequence[str], records: Sequence[Column]) -> DataFrame:
    """One output row per record and input row, with the ``keep`` columns in front."""
    return df.select(*keep, F.inline(F.array(*records)))


def local_table(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A small driver-side table (fitted values, configuration) as a local relation."""
    struct = T._parse_datatype_string(schema)
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), schema=to_arrow_schema(struct)), schema=struct)


def fitted(df: DataFrame) -> DataFrame:
    """Run a plan whose result is a few fitted values for each label, and keep them as a local table.

    The values are then constants of every later plan.
    """
    rows = df.collect()
    return local_table(df.sparkSession, [r.asDict(recursive=True) for r in rows], df.schema.simpleString())
