"""Stops outside their window.

Here a stop is judged as a whole: its earliest arrival against its first window end. That is not the
same as "no order of the delivery is on time", where each order meets its own window end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.functions.clocks import minutes, with_clocks, with_hhmm
from punctual.functions.measures import OUTSIDE_BUCKETS, clamp, outside_bucket, percent
from punctual.operators.firsts import clock_value, stops_with_activity
from punctual.sources.orders import select_orders
from punctual.sources.schema import STOP, present


def outside_stops(orders: DataFrame, **filters) -> DataFrame:
    """One row per stop with minutes late and an outside flag; unknown times count as outside."""
    rows = with_clocks(present(select_orders(orders, **filters), *STOP), "actual", "win_until", "planned")
    clocks = ("actual", "win_until", "planned")
    firsts = {"win_until_ts": ("win_until_ts", "win_until_ts"), **{c: (clock_value(rows, c), c) for c in clocks}}
    stops = stops_with_activity(rows, firsts, ["actual_ts", "planned_ts"], {"orders": "cnr_cust"})
    stops = stops.select(*STOP, "rfx_activity", "actual_ts", "win_until_ts", "planned_ts", *clocks, "orders")
    return with_hhmm(stops, *clocks).withColumns(
        {
            "late_minutes": clamp(minutes("win_until_ts", "actual_ts")),
            "outside_s2": F.coalesce(F.col("actual_ts") > F.col("win_until_ts"), F.lit(True)),
        }
    )


def outside_daily(
    orders: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    rfx_activity: str | None = None,
) -> DataFrame:
    """Shops and outside stops per day.

    The share is stops over distinct shops, so a shop served by two routes can give more than 100.
    """
    return (
        outside_stops(orders, date_from=date_from, date_to=date_to, rfx_activity=rfx_activity)
        .groupBy("date_dos", "nm_short_unload")
        .agg(F.count_if("outside_s2").alias("n"))
        .groupBy("date_dos")
        .agg(F.count(F.lit(1)).alias("leverpunten"), F.sum("n").alias("leverpunten_outside"))
        .withColumn("outside_pct", percent(F.col("leverpunten_outside"), F.col("leverpunten")))
        .orderBy("date_dos")
    )


def outside_points(
    orders: DataFrame, date: str | None = None, rfx_activity: str | None = None
) -> DataFrame:
    """Outside stops, for one day the latest first."""
    rows = outside_stops(orders, date_from=date, date_to=date, rfx_activity=rfx_activity)
    rows = rows.where("outside_s2")
    return rows.orderBy(F.desc_nulls_last("late_minutes"), *STOP) if date else rows


def outside_buckets_daily(
    orders: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    rfx_activity: str | None = None,
) -> DataFrame:
    """Outside stops per day and lateness bucket: count, share, and the rate if all up to that bucket
    had been on time. Days without an outside stop are absent; stops with unknown lateness count as
    outside but in no cumulative rate.
    """
    stops = outside_stops(orders, date_from=date_from, date_to=date_to, rfx_activity=rfx_activity)
    bucket, outside = outside_bucket(F.col("late_minutes")), F.col("outside_s2")
    tags = {name: name.replace("-", "_").replace("60+", "60_plus") for name, _ in OUTSIDE_BUCKETS}
    days = (
        stops.groupBy("date_dos")
        .agg(
            F.count(F.lit(1)).alias("total_deliveries"),
            F.count_if(outside).alias("totaal_buiten_jit"),
            *[F.count_if(outside & (bucket == name)).alias(f"cnt_{tag}") for name, tag in tags.items()],
            F.count_if(outside & (bucket == "unknown")).alias("unknown"),
        )
        .where(F.col("totaal_buiten_jit") > 0)
    )
    n = F.col("total_deliveries")
    days = days.withColumn("huidige_jit_pct", percent(n - F.col("totaal_buiten_jit"), n))
    days = days.withColumns({f"pct_{tag}": percent(F.col(f"cnt_{tag}"), n) for tag in tags.values()})
    columns, so_far = ["date_dos", "total_deliveries", "totaal_buiten_jit", "huidige_jit_pct"], None
    running = {}
    for tag in tags.values():
        so_far = F.col(f"pct_{tag}") if so_far is None else so_far + F.col(f"pct_{tag}")
        running[f"jit_pct_cumul_{tag}"] = F.col("huidige_jit_pct") + so_far
        columns += [f"cnt_{tag}", f"pct_{tag}", f"jit_pct_cumul_{tag}"]
    return days.withColumns(running).select(*columns, "unknown").orderBy("date_dos")
