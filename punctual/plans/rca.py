"""Delay drivers: waiting, lateness, late departure and transit along a route.

A stop here is (day, tour, shop, activity) and takes its values from its first order, missing ones
included. Missing keys are kept as the text ``nan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.functions.clocks import minutes, with_clocks, with_hhmm
from punctual.functions.measures import clamp, late_bucket, total
from punctual.functions.text import MISSING_ID, stored_number
from punctual.operators import route_order
from punctual.operators.firsts import clock_value, first_row
from punctual.sources.orders import select_orders
from punctual.sources.schema import ROUTE, present

_KEYS = ["date_dos", "cnr_tour", "rfx_activity", "nm_short_unload"]
_CLOCKS = ["planned", "actual", "a_depart", "win_until"]


def _with_text_keys(orders: DataFrame) -> DataFrame:
    return orders.withColumns({k: F.coalesce(k, F.lit(MISSING_ID)) for k in _KEYS})


def _stops(orders: DataFrame, has_duration_a: bool) -> DataFrame:
    rows = with_clocks(_with_text_keys(orders), *_CLOCKS)
    stops = (
        rows.withColumn("wait", stored_number(rows, "duration_a"))
        .groupBy(*_KEYS)
        .agg(
            *[first_row(f"{c}_ts").alias(f"{c}_ts") for c in _CLOCKS],
            *[first_row(clock_value(rows, c)).alias(c) for c in _CLOCKS],
            first_row("wait").alias("wait_min"),
            F.count(F.lit(1)).alias("orders"),
        )
    )
    if not has_duration_a:
        stops = stops.withColumn("wait_min", minutes("actual_ts", "a_depart_ts"))
    late = clamp(minutes("win_until_ts", "actual_ts"))
    return (
        with_hhmm(stops, *_CLOCKS)
        .withColumn("late_min", late)
        .withColumn("late_bucket", late_bucket(F.col("late_min")))
        .drop("win_until_ts")
    )


def rca_stops(
    orders: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    rfx_activity: str | None = None,
    has_duration_a: bool = True,
) -> DataFrame:
    """Stop table. ``has_duration_a`` says whether the file has actual durations at all; only if it
    has none the wait is departure minus arrival. There is no fallback per row.
    """
    orders = select_orders(orders, date_from, date_to, rfx_activity)
    return _stops(orders, has_duration_a)


def rca_stop_sequence(
    orders: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    rfx_activity: str | None = None,
    has_duration_a: bool = True,
) -> DataFrame:
    """Stops with the departure and plan of the stop before, and the delay split into its parts."""
    orders = select_orders(orders, date_from, date_to, rfx_activity)
    values = {"prev_a_depart": "a_depart_ts", "prev_planned": "planned_ts"}
    stops = route_order.previous(_stops(orders, has_duration_a), "planned_ts", "rfx_activity", values)
    return stops.withColumns(
        {
            "transit_actual_min": minutes("prev_a_depart", "actual_ts"),
            "transit_planned_min": minutes("prev_planned", "planned_ts"),
            # Departure there against planned arrival there, so it includes the time on site.
            "late_departure_proxy_min": minutes("prev_planned", "prev_a_depart"),
        }
    ).withColumn("transit_delay_min", F.col("transit_actual_min") - F.col("transit_planned_min"))


def rca_route_decomposition(orders: DataFrame, **options) -> DataFrame:
    """Sums per route and activity over stops that have a known stop before them, so the first stop
    of a route never counts and a route of one stop is absent. Largest late departure first.
    """
    sums = {
        "total_wait_min": "wait_min",
        "total_late_min": "late_min",
        "sum_late_depart_proxy_min": "late_departure_proxy_min",
        "sum_transit_delay_min": "transit_delay_min",
    }
    return (
        present(rca_stop_sequence(orders, **options), "prev_a_depart", "prev_planned")
        .groupBy("date_dos", "cnr_tour", "rfx_activity")
        .agg(
            F.count(F.lit(1)).alias("stops"),
            *[F.bround(total(F.col(c)), 2).alias(name) for name, c in sums.items()],
        )
        .orderBy(
            F.desc("sum_late_depart_proxy_min"), F.desc("sum_transit_delay_min"), *ROUTE, "rfx_activity"
        )
    )


def rca_late_buckets(orders: DataFrame, **options) -> DataFrame:
    """Distinct shops per day, activity and lateness bucket."""
    keys = ["date_dos", "rfx_activity", "late_bucket"]
    shops = rca_stops(orders, **options).select(*keys, "nm_short_unload").distinct()
    return shops.groupBy(*keys).agg(F.count(F.lit(1)).alias("leverpunten")).orderBy(*keys)


def rca_customer_day(orders: DataFrame, **options) -> DataFrame:
    """Distinct shops and routes, total wait and total lateness per day and activity."""
    keys = ["date_dos", "rfx_activity"]
    stops = rca_stops(orders, **options)
    sums = {"wait": "wait_min", "late": "late_min"}

    def rolled(key: str, count: str, tag: str) -> DataFrame:
        each = stops.groupBy(*keys, key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        return each.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *[F.sum(n).alias(f"{n}_{tag}") for n in sums])

    # Counting by two kinds of distinct value at once would send every stop twice. Both roll-ups read the same combined
    # stops; that each carries both sums keeps their inputs equal, so that the exchange, and the scan below it, is reused.
    both = rolled("nm_short_unload", "leverpunten", "s").join(rolled("cnr_tour", "routes", "r"), keys)
    totals = {f"total_{n}_min": F.coalesce(f"{n}_s", f"{n}_r", F.lit(0.0)) for n in sums}
    # Keys are never missing here.
    return (
        both.select(*keys, "leverpunten", "routes", *[c.alias(n) for n, c in totals.items()])
        .orderBy("date_dos", F.desc("total_wait_min"), "rfx_activity")
    )


def rca_detail(
    orders: DataFrame,
    date: str | None = None,
    rfx_activity: str | None = None,
    has_duration_a: bool = True,
) -> DataFrame:
    """Stops of one day and activity, longest wait first; or of every day and activity."""
    rows = present(select_orders(orders, date, date, rfx_activity), "date_dos", "rfx_activity")
    rows = _stops(rows, has_duration_a)
    if date and rfx_activity:
        rows = rows.orderBy(F.desc_nulls_last("wait_min"), "cnr_tour", "nm_short_unload")
    return rows.select(
        "date_dos", "rfx_activity", "cnr_tour", "nm_short_unload", "orders", *_CLOCKS, "wait_min", "late_min"
    )
