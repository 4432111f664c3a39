"""Rating extraction from scored text, one pattern per answer dialect."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns: (regex, capture groups tried in order, lowest, highest accepted rating).
DIALECTS = {
    # "(4.5 stars, 80%)", "4 Star"
    "stars": (r"(?i)(\d+(\.\d+)?)\s*(stars|star)\b", (1,), 1.0, 5.0),
    # first whole number
    "integer": (r"(\d+)", (1,), 1.0, 5.0),
    # number before star(s), or after "rating" or "would be"
    "phrase": (
        r"(\d+(\.\d*)?)\s*(?=stars|star)|rating\s*(\d+(\.\d*)?)|would be\s*(\d+(\.\d*)?)",
        (1, 3, 5), 0.5, 5.0,
    ),
    # first number, whole or decimal
    "number": (r"(\d+(\.\d+)?)", (1,), 0.5, 5.0),
    # first single digit
    "digit": (r"(\d)", (1,), 1.0, 5.0),
}


def numeric(text: Column) -> Column:
    """The whole text as a double, null when it is not one."""
    return F.trim(text).try_cast("double")


def parse_rating(text: Column, dialect: str = "stars", invalid: float | None = None) -> Column:
    """Rating found in ``text``; null (or ``invalid``) when absent or out of range."""
    if dialect == "whole":
        value, low, high = numeric(text), 0.5, 5.0
    else:
        pattern, groups, low, high = DIALECTS[dialect]
        found = [F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in groups]
        value = F.coalesce(*found).try_cast("double")
    kept = F.when(value.between(low, high), value)
    return kept if invalid is None else F.coalesce(kept, F.lit(float(invalid)))


def failed(prediction: Column) -> Column:
    """True when a stored prediction is not a number (error text, blank, null, NaN)."""
    value = numeric(prediction)
    return value.isNull() | F.isnan(value)
