"""Export of drift reports as CSV folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tranche.sources.storage import write_csv


def report_path(folder: str, base: str, tag: str | None, part: str) -> str:
    suffix = f"_{tag}" if tag else ""
    return f"{folder.rstrip('/')}/{base}{suffix}_{part}.csv"


def arrays_as_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Array cells as JSON text, which CSV can hold; other columns pass through."""
    arrays = [c for c, t in df.dtypes if t.startswith("array") and (columns is None or c in columns)]
    return df.withColumns({c: F.to_json(F.col(c)) for c in arrays})


def _export(report: dict[str, DataFrame], parts: list[str], folder: str, base: str, tag: str | None) -> dict[str, str]:
    written = {}
    for part in parts:
        path = report_path(folder, base, tag, part)
        write_csv(arrays_as_json(report[part]), path)
        written[part] = path
    return written


def export_string_report(report: dict[str, DataFrame], folder: str | None, base: str = "string_alignment", tag: str | None = None) -> dict[str, str]:
    """Write summary, deltas, top deltas and, when there are any, value differences. No folder, no export."""
    if not folder or not folder.strip():
        return {}
    parts = ["summary", "deltas", "top_deltas"]
    if not report["value_differences"].isEmpty():
        parts.append("value_differences")
    return _export(report, parts, folder, base, tag)


def export_numeric_report(report: dict[str, DataFrame], folder: str | None, base: str = "numerical_alignment", tag: str | None = None) -> dict[str, str]:
    if not folder or not folder.strip():
        return {}
    return _export(report, ["summary", "deltas", "top_deltas"], folder, base, tag)
