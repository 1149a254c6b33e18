"""Columns for people: durations, shares and cardinalities as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """``2d 3h``, ``4h 5m``, ``6m 7s`` or ``8.0s``; a minus sign for negative values."""
    s = F.abs(seconds)
    whole = F.floor(s).cast("long")
    two = lambda big, small, a, b: F.concat(F.floor(whole / big).cast("string"), F.lit(a), F.floor(whole % big / small).cast("string"), F.lit(b))
    text = F.when(s >= 86400, two(86400, 3600, "d ", "h")).when(s >= 3600, two(3600, 60, "h ", "m")).when(s >= 60, two(60, 1, "m ", "s")).otherwise(F.format_string("%.1fs", s))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), text)


def percent(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)
