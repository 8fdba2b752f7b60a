"""Text cleaning expressions. All of them keep nulls and stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tranche.functions.guards import known

# The whitespace characters that stripping and collapsing know.
WHITESPACE = " \t\n\r\f\x0b"
# Month text as written in the raw extracts.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Fixed value: two-digit years from here on belong to the 1900s.
TWO_DIGIT_YEAR_PIVOT = 69
# Spellings of "no answer" in the employment-length column.
MISSING_EMPLOYMENT_TOKENS = ["n/a", "na", "n.a."]


def strip(column: Column) -> Column:
    """Trim every kind of whitespace (Spark's plain ``trim`` removes blanks only)."""
    return F.btrim(column.cast("string"), F.lit(WHITESPACE))


def collapse(column: Column) -> Column:
    """Runs of whitespace become one blank; the regex runs only on values that have a run."""
    blanks = F.translate(column, WHITESPACE, " " * len(WHITESPACE))
    return F.when(F.contains(blanks, F.lit("  ")), F.regexp_replace(blanks, " +", " ")).otherwise(blanks)


def normalise(
    column: Column,
    lowercase: bool = True,
    strip_whitespace: bool = True,
    collapse_whitespace: bool = True,
    underscores: bool = True,
) -> Column:
    text = column.cast("string")
    if strip_whitespace:
        text = strip(text)
    if collapse_whitespace:
        text = collapse(text)
    if lowercase:
        text = F.lower(text)
    if underscores:
        text = F.replace(text, F.lit(" "), F.lit("_"))
    return text


def percent_to_double(column: Column) -> Column:
    """``'13.56%'`` -> 13.56; text that is not a number fails the job (ANSI cast)."""
    return strip(F.replace(column.cast("string"), F.lit("%"), F.lit(""))).cast("double")


def first_integer(column: Column) -> Column:
    """First run of digits as smallint, null when there is none."""
    digits = F.regexp_extract(column.cast("string"), r"(\d+)", 1)
    return F.nullif(digits, F.lit("")).cast("smallint")


def lookup(column: Column, mapping: dict, allow_unmapped: bool = False, what: str = "value") -> Column:
    """Literal map lookup. Unmapped values fail the job unless they are allowed to pass."""
    if not mapping:
        raise ValueError("mapping must not be empty")
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), column)
    if allow_unmapped:
        return F.coalesce(found.cast("string"), column)
    return known(found, column, f"unmapped {what}: ")


def employment_years(column: Column) -> Column:
    """``'< 1 year'`` 0, ``'3 years'`` 3, ``'10+ years'`` 10, ``'n/a'`` null, all else fails."""
    text = F.lower(strip(column))
    text = F.when(~text.isin(MISSING_EMPLOYMENT_TOKENS), text)
    years = {"< 1 year": 0, "10+ years": 10}
    for n in range(1, 10):
        years[f"{n} year"] = n
        years[f"{n} years"] = n
    return lookup(text, years, what="employment length").cast("float")


def month_start(column: Column, formats: tuple[str, ...] = ("MMM-yyyy", "MMM-yy")) -> Column:
    """Parse month text with the first format that fits; unreadable text fails the job."""
    text = strip(column)
    attempts = []
    for fmt in formats:
        parsed = F.try_to_timestamp(text, F.lit(fmt))
        if fmt.count("y") == 2:
            century = F.year(parsed) >= 2000 + TWO_DIGIT_YEAR_PIVOT
            parsed = F.when(century, parsed - F.expr("INTERVAL '100' YEAR")).otherwise(parsed)
        attempts.append(parsed)
    return known(F.coalesce(*attempts), text, "unreadable month: ")
