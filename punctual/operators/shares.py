"""Share of the grand total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def grand_total(counts: DataFrame, name: str) -> Column:
    """Total of a count column as a scalar subquery.

    It reads the same grouped counts as the rows it is compared with, so the shuffle is reused, and
    no single-partition window is needed.
    """
    return counts.agg(F.sum(name)).scalar()
