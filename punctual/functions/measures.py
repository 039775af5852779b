"""Percentages, flags, grades and buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_true(cond: Column) -> Column:
    """A condition on missing times is false."""
    return F.coalesce(cond, F.lit(False))


def percent(n: Column, d: Column) -> Column:
    """Unrounded percentage, 0 for an empty denominator."""
    return F.when(d > 0, n / d * F.lit(100.0)).otherwise(F.lit(0.0))


def percent2(n: Column, d: Column) -> Column:
    """Percentage with two decimals, half-even."""
    return F.bround(percent(n, d), 2)


def clamp(x: Column) -> Column:
    """Negative becomes 0, missing stays missing."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))


def total(x: Column) -> Column:
    """Sum that is 0 when every value is missing."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def route_grade(pct: Column) -> Column:
    return F.when(pct < 93, "bad").when(pct < 95, "mid").otherwise("good")


def row_grade(s1: Column, s2: Column) -> Column:
    return F.when(s1 & s2, "ok").when(s2, "late").otherwise("root")


# Bucket names and upper bounds in minutes, bounds inclusive.
OUTSIDE_BUCKETS = [("0-15", 15), ("15-30", 30), ("30-45", 45), ("45-60", 60), ("60+", None)]
LATE_BUCKETS = [("0", 0), ("0–15", 15), ("15–30", 30), ("30–60", 60), ("60+", None)]


def _bucket(x: Column, buckets: list[tuple[str, int | None]]) -> Column:
    out = F.when(x.isNull(), "unknown")
    for name, upper in buckets:
        out = out.otherwise(name) if upper is None else out.when(x <= upper, name)
    return out


def outside_bucket(late_min: Column) -> Column:
    return _bucket(late_min, OUTSIDE_BUCKETS)


def late_bucket(late_min: Column) -> Column:
    return _bucket(late_min, LATE_BUCKETS)


def wait_bucket(extra_min: Column) -> Column:
    # Report labels.
    return (
        F.when(extra_min.isNull(), "Onbekend / ontbrekende wachttijd")
        .when(extra_min > 30, "Ernstige wachttijd >30 min")
        .when(extra_min > 10, "Matige wachttijd 10–30 min")
        .when(extra_min >= 0, "Lichte wachttijd 0–10 min")
        .otherwise("Geen extra wachttijd / vroeger weg")
    )


def delay_class(start_delay: Column, max_delay: Column) -> Column:
    # Cluster labels. A missing start delay falls through to the last one.
    return (
        F.when(start_delay > 10, "Planning/Dispatch")
        .when((start_delay <= 10) & (max_delay > 15), "Sequencing / Route design")
        .otherwise("Stable / On time")
    )
