"""Evaluating costly columns once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(table: DataFrame, *names: str) -> DataFrame:
    """The same table, with the named columns evaluated once per row.

    A filter on a computed column is moved below it by copying the whole expression, which then runs twice, and
    more often still when it builds on other computed columns. Filters are not moved through a generator, so
    the columns pass through one that makes exactly one row.
    """
    others = [c for c in table.columns if c not in names]
    return table.select(*others, F.inline(F.array(F.struct(*names)))).select(*table.columns)
