"""Column names that neither break nor clash."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, lengthened until no taken name equals it in any case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name
