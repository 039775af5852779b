"""Text and number cleaning.

The functions here and in ``clocks`` take column names or SQL text. Each becomes one parsed expression,
which keeps building a plan cheap; the ``_sql`` forms are for nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

MISSING_ID = "nan"


def strip_sql(c: str) -> str:
    """Text without blanks, tabs and line ends around it."""
    return f"btrim(cast({c} AS string), ' \\t\\r\\n')"


def id_text(c: str) -> Column:
    """Identifier text: trimmed, and a missing one becomes a value of its own, so it forms a group."""
    return F.expr(f"coalesce({strip_sql(c)}, '{MISSING_ID}')")


def stored_number(df: DataFrame, c: str) -> Column:
    """The number that ingest stored for a text, or else the text read as a number."""
    return F.col(f"{c}_num") if f"{c}_num" in df.columns else number(c)


def number(c: str) -> Column:
    """Text as DOUBLE; anything that is not a plain decimal number is NULL.

    The pattern is needed because a bare cast also takes forms such as ``1.0d`` or ``Infinity``; text
    that does not match becomes blank, which casts to NULL.
    """
    return F.expr(f"try_cast(regexp_extract({strip_sql(c)}, r'{_NUMBER}', 0) AS double)")
