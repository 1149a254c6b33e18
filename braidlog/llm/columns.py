"""Column names that cannot clash with those of the input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column is called so (names do not tell cases apart)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")
