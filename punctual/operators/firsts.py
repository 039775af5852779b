"""First values by file order, as aggregates.

``row_ord`` is a LONG on purpose: with a numeric value the aggregation buffer is fixed-width, which
keeps Spark on hash aggregation with map-side combine. A struct as order key would force sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from punctual.functions.clocks import clock_code_sql, is_typed
from punctual.sources.schema import STOP


def first_filled(value: str, filled: str | None = None) -> Column:
    """Value of the first row in which ``filled`` (the value itself by default) is not NULL."""
    return F.expr(f"min_by({value}, row_ord) FILTER (WHERE {filled or value} IS NOT NULL)")


def first_row(value: str) -> Column:
    """Value of the first row, NULL included."""
    return F.expr(f"min_by({value}, row_ord)")


def clock_value(rows: DataFrame, name: str) -> str:
    """What stands for a clock text in an aggregate: its code where seconds are stored, else the text."""
    return clock_code_sql(name) if is_typed(rows, name) else name


def first_clock(rows: DataFrame, name: str) -> Column:
    """First filled text of a clock column, to be shown by ``with_hhmm``."""
    return first_filled(clock_value(rows, name), name)


def number_value(rows: DataFrame, name: str) -> str:
    return f"{name}_num" if f"{name}_num" in rows.columns else name


def stops_with_activity(rows: DataFrame, firsts: dict[str, tuple[str, str]], lows: list[str], counts: dict[str, str]) -> DataFrame:
    """One row per stop, with the activity of its first order that has one (``rfx_activity``) and that of its first order.

    ``firsts``: name -> (value, column that must be filled); ``lows``: columns whose smallest value is wanted;
    ``counts``: name -> column. ``row_ord`` becomes that of the first order, and ``<name>_ord`` is where a first value was found.

    An activity is a text of any length, which no buffer of a hash aggregation holds. So orders are first combined by
    stop and activity, with numbers as only buffers, and the few rows per stop then by stop.
    """
    each = rows.groupBy(*STOP, "rfx_activity").agg(
        *[first_filled(value, filled).alias(name) for name, (value, filled) in firsts.items()],
        *[F.expr(f"min(row_ord) FILTER (WHERE {filled} IS NOT NULL)").alias(f"{name}_ord") for name, (_, filled) in firsts.items()],
        *[F.min(c).alias(c) for c in lows],
        *[F.count(c).alias(name) for name, c in counts.items()],
        F.min("row_ord").alias("row_ord"),
    )
    return each.groupBy(*STOP).agg(
        first_filled("rfx_activity").alias("rfx_activity"),
        first_row("rfx_activity").alias("first_activity"),
        *[F.min_by(name, f"{name}_ord").alias(name) for name in firsts],
        *[F.min(f"{name}_ord").alias(f"{name}_ord") for name in firsts],
        *[F.min(c).alias(c) for c in lows],
        *[F.sum(name).alias(name) for name in counts],
        F.min("row_ord").alias("row_ord"),
    )
