"""Root causes of late deliveries and the action plan drawn from them."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from punctual.functions.lookups import reason_cluster, recommendation
from punctual.functions.measures import percent, percent2
from punctual.operators.shares import grand_total
from punctual.sources.schema import present, require, with_optional

SEGMENT_KEYS = ["customer", "site", "cnr_tour", "nm_short_unload"]


def _late(rows: DataFrame) -> DataFrame:
    require(rows, ["on_time"], "rows need the flag computed by kpi_rows")
    return rows.where(~F.col("on_time"))


def _with_share(counts: DataFrame, *keys: str) -> DataFrame:
    share = percent2(F.col("count"), grand_total(counts, "count"))
    return counts.withColumn("share_pct", share).orderBy(F.desc("count"), *keys)


def root_cause_pareto(rows: DataFrame) -> DataFrame:
    """Late rows per root-cause cluster with shares, largest first."""
    late = with_optional(_late(rows), "reason")
    counts = late.groupBy(reason_cluster(F.col("reason")).alias("reason_bucket")).count()
    return _with_share(counts, "reason_bucket")


def root_cause_segments(rows: DataFrame) -> DataFrame:
    """Late rows per combination of those segment columns that exist.

    Shares are over rows with every key filled, so they add up to 100 among themselves. Without any
    segment column there is nothing to report.
    """
    keys = [k for k in SEGMENT_KEYS if k in rows.columns]
    if not keys:
        return _late(rows).select(
            F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("share_pct")
        ).where(F.lit(False))
    return _with_share(present(_late(rows), *keys).groupBy(*keys).count(), *keys)


def action_plan(
    pareto: DataFrame,
    current_kpi_pct: float | Column,
    target_sla: float = 97.0,
    horizon_days: int = 14,
    as_of: date | None = None,
) -> DataFrame:
    """A recommendation per cluster, largest impact first.

    ``current_kpi_pct`` is a number or a column, for instance a scalar subquery on the KPI.
    """
    current = current_kpi_pct if isinstance(current_kpi_pct, Column) else F.lit(float(current_kpi_pct))
    needed = F.greatest(F.lit(0.0), F.lit(float(target_sla)) - current)
    cluster = F.col("reason_bucket")
    impact = F.least(needed, recommendation(cluster, 2) * F.col("share_pct") / F.lit(10.0))
    due = (as_of or datetime.now(timezone.utc).date()) + timedelta(days=horizon_days)
    return (
        pareto.select(
            cluster.alias("oorzaak_cluster"),
            F.bround(impact, 2).alias("impact_pct_pts"),
            recommendation(cluster, 0).alias("aanbevolen_maatregel"),
            recommendation(cluster, 1).alias("verantwoordelijke"),
            F.lit(due.isoformat()).alias("deadline"),
            "count",
        )
        .orderBy(F.desc("impact_pct_pts"), F.desc("count"), "oorzaak_cluster")
        .drop("count")
    )


def action_plan_of(rows: DataFrame, **options) -> DataFrame:
    """``action_plan`` of rows with their ``on_time`` flag, from one scan.

    Late and on-time rows are counted per cluster in one aggregation; the KPI and the shares come from these few
    counts.
    """
    require(rows, ["on_time"], "rows need the flag computed by kpi_rows")
    cluster = reason_cluster(F.col("reason")).alias("reason_bucket")
    counts = with_optional(rows, "reason").groupBy(cluster).agg(F.count(F.lit(1)).alias("all"), F.count_if("on_time").alias("on_time"))
    kpi = F.bround(percent(F.col("on_time"), F.col("all")), 2)
    current = counts.agg(F.sum("on_time").alias("on_time"), F.sum("all").alias("all")).select(kpi).scalar()
    late = counts.select("reason_bucket", (F.col("all") - F.col("on_time")).alias("count")).where("count > 0")
    return action_plan(_with_share(late, "reason_bucket"), current, **options)
