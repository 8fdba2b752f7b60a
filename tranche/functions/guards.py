"""In-plan guards: a broken contract fails the job in the pass that reads the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ensure(condition: Column, value: Column, message: str | Column) -> Column:
    """``value`` where ``condition`` is true; otherwise the job fails with ``message``."""
    text = F.lit(message) if isinstance(message, str) else F.coalesce(message, F.lit("contract broken"))
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(text))


def known(value: Column, source: Column, message: str) -> Column:
    """``value``, evaluated once; the job fails where it is null although ``source`` is not."""
    return F.coalesce(value, F.when(source.isNotNull(), F.raise_error(F.concat(F.lit(message), source))))


def binary_target(column: str) -> Column:
    c = F.col(column)
    return ensure(c.isin(0, 1), c.cast("bigint"), f"{column} must be 0 or 1 and not null")


def not_null(column: str) -> Column:
    c = F.col(column)
    return ensure(c.isNotNull(), c, f"{column} must not be null")


def require_columns(df, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing required columns: {missing}")
