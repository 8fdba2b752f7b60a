"""Display text for money and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(column: Column, digits: int = 2, signed: bool = False) -> Column:
    """0.1234 -> ``12.34%``."""
    plus = "+" if signed else ""
    return F.format_string(f"%{plus}.{digits}f%%", column * 100)


def percent_points(column: Column, digits: int = 2) -> Column:
    """12.345 (already in percent) -> ``12.35%``."""
    return F.format_string(f"%.{digits}f%%", column)


def money(column: Column, sign_first: bool = False) -> Column:
    """1234.5 -> ``$1,235``; negatives as ``$-1,235`` or, sign first, ``-$1,235``."""
    amount = F.format_string("$%,.0f", column)
    if not sign_first:
        return amount
    return F.when(column < 0, F.format_string("-$%,.0f", F.abs(column))).otherwise(amount)
