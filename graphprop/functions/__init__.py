"""Small column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int = 6) -> Column:
    """A double in units of 10^-digits, half up: the same long in any engine."""
    return F.floor(value * float(10**digits) + 0.5).cast("long")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def trim_all(text: Column) -> Column:
    """Blanks of all kinds off both ends."""
    return F.regexp_replace(text, r"^[\s]+|[\s]+$", "")
