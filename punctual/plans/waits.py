"""Waiting time on site. Orders without a numeric actual duration are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.functions.clocks import with_clocks, with_hhmm
from punctual.functions.text import stored_number
from punctual.sources.orders import select_orders
from punctual.sources.schema import STOP, present


def _waiting(orders: DataFrame, **filters) -> DataFrame:
    rows = select_orders(orders, **filters)
    return present(rows.withColumn("duration_a_min", stored_number(rows, "duration_a")), "duration_a_min")


def _delivery_waits(orders: DataFrame, **filters) -> DataFrame:
    """Mean wait per delivery of one customer; orders of two customers at a shop are two deliveries."""
    keys = ["rfx_activity", *STOP]
    rows = present(_waiting(orders, **filters), *keys)
    return rows.groupBy(*keys).agg(F.avg("duration_a_min").alias("avg_wait_min"))


def waits_by_customer(
    orders: DataFrame, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Deliveries, shops, total and mean wait per customer, longest total first."""
    return (
        _delivery_waits(orders, date_from=date_from, date_to=date_to)
        .groupBy("rfx_activity", "nm_short_unload")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("avg_wait_min").alias("wait"))
        .groupBy("rfx_activity")
        .agg(
            F.sum("n").alias("deliveries"),
            F.count(F.lit(1)).alias("leverpunten"),
            F.sum("wait").alias("total_wait_min"),
        )
        .withColumn("avg_wait_per_delivery", F.col("total_wait_min") / F.col("deliveries"))
        .orderBy(F.desc("total_wait_min"), "rfx_activity")
    )


def waits_by_store(
    orders: DataFrame,
    rfx_activity: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Deliveries and total wait per customer and shop, longest total first."""
    return (
        _delivery_waits(orders, rfx_activity=rfx_activity, date_from=date_from, date_to=date_to)
        .groupBy("rfx_activity", "nm_short_unload")
        .agg(F.count(F.lit(1)).alias("deliveries"), F.sum("avg_wait_min").alias("total_wait_min"))
        .orderBy("rfx_activity", F.desc("total_wait_min"), "nm_short_unload")
    )


def waits_by_delivery(
    orders: DataFrame,
    rfx_activity: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Mean wait per delivery; sorted, longest first, for one customer."""
    rows = _delivery_waits(orders, rfx_activity=rfx_activity, date_from=date_from, date_to=date_to)
    return rows.orderBy(F.desc("avg_wait_min"), *STOP) if rfx_activity else rows


def waits_store_orders(
    orders: DataFrame,
    rfx_activity: str | None = None,
    store: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Order lines with their wait; sorted along the day for one customer and shop."""
    rows = _waiting(orders, rfx_activity=rfx_activity, date_from=date_from, date_to=date_to)
    rows = present(rows, "nm_short_unload")
    if store:
        rows = rows.where(F.col("nm_short_unload") == store)
    if store and rfx_activity:
        order = [F.col(c) for c in ("date_dos", "cnr_tour", "planned_ts", "actual")]
        rows = with_clocks(rows, "planned").orderBy(*[c.asc_nulls_last() for c in order], "row_ord")
    clocks = ("win_from", "win_until", "planned", "actual", "a_depart")
    return with_hhmm(rows, *clocks).select(
        "rfx_activity", "nm_short_unload", "date_dos", "cnr_tour", "cnr_cust", *clocks,
        "duration_a_min",
    )
