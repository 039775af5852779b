"""Just-in-time rates per order, delivery and route.

An order is on time in sense 1 if it arrives inside its window, and in sense 2 if it arrives no
later than the end of the window. A delivery (day, tour, shop) is on time if any of its orders is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.functions.clocks import with_clocks, with_hhmm, with_texts
from punctual.functions.measures import is_true, percent, route_grade, row_grade
from punctual.operators.firsts import first_clock
from punctual.sources.orders import select_orders
from punctual.sources.schema import ROUTE, STOP, TYPED_COLUMNS, present


def stop_order_flags(orders: DataFrame, **filters) -> DataFrame:
    """Orders with the four parsed times and both on-time flags."""
    return _flags(orders, **filters).drop(*TYPED_COLUMNS)


def _flags(orders: DataFrame, **filters) -> DataFrame:
    rows = with_clocks(select_orders(orders, **filters), "win_from", "win_until", "actual", "planned")
    actual, until = F.col("actual_ts"), F.col("win_until_ts")
    return rows.withColumns(
        {
            "jit_s1_order": is_true((actual >= F.col("win_from_ts")) & (actual <= until)),
            "jit_s2_order": is_true(actual <= until),
        }
    )


def stop_deliveries(orders: DataFrame, **filters) -> DataFrame:
    """One row per delivery."""
    stops = _stops(orders, **filters)
    return with_texts(stops, "win_from", "win_until", "first_planned", "first_actual")


def _stops(orders: DataFrame, **filters) -> DataFrame:
    """Deliveries, with their first clocks as codes where seconds are stored."""
    rows = present(_flags(orders, **filters), *STOP)
    return (
        rows.groupBy(*STOP)
        .agg(
            F.count("cnr_cust").alias("orders"),
            first_clock(rows, "win_from").alias("win_from"),
            first_clock(rows, "win_until").alias("win_until"),
            first_clock(rows, "planned").alias("first_planned"),
            first_clock(rows, "actual").alias("first_actual"),
            F.bool_or("jit_s1_order").alias("jit_s1_delivery"),
            F.bool_or("jit_s2_order").alias("jit_s2_delivery"),
            F.min("planned_ts").alias("first_planned_ts"),
        )
    )


def routes_overview(
    orders: DataFrame, route_input: str | None = None, route_select: str | None = None, **filters
) -> DataFrame:
    """Rates per route and day. A typed route wins over a chosen one; ``ALL`` means every route.

    Two aggregations: orders to deliveries, deliveries to routes. The first is by delivery and not by
    route, so map-side combining shrinks a very large route before anything is shuffled. Orders
    without shop count as orders of the route but make no delivery.
    """
    route = (route_input or "").strip() or (route_select if route_select != "ALL" else None)
    if route:
        filters["cnr_tour"] = route
    s1, s2, shop = F.col("s1"), F.col("s2"), F.col("nm_short_unload").isNotNull()
    routes = (
        present(_flags(orders, **filters), *ROUTE)
        .groupBy(*STOP)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("jit_s1_order").alias("s1"),
            F.count_if("jit_s2_order").alias("s2"),
        )
        .groupBy(*ROUTE)
        .agg(
            F.count_if(shop).alias("deliveries"),
            F.count_if(shop & (s1 > 0)).alias("jit_s1_del"),
            F.count_if(shop & (s2 > 0)).alias("jit_s2_del"),
            F.sum("n").alias("orders"),
            F.sum("s1").alias("jit_s1_ord"),
            F.sum("s2").alias("jit_s2_ord"),
        )
    )
    rates = {f"{c}_pct": percent(F.col(c), F.col("deliveries")) for c in ("jit_s1_del", "jit_s2_del")}
    rates |= {f"{c}_pct": percent(F.col(c), F.col("orders")) for c in ("jit_s1_ord", "jit_s2_ord")}
    return (
        routes.withColumns(rates)
        .withColumn("route_grade", route_grade(F.col("jit_s2_del_pct")))
        .orderBy(*ROUTE)
    )


def _one_route(date: str | None, cnr_tour: str | None) -> dict:
    return {"date_from": date, "date_to": date, "cnr_tour": cnr_tour}


def route_detail_header(
    orders: DataFrame, date: str | None = None, cnr_tour: str | None = None
) -> DataFrame:
    """Order count and order rates of a route, or of every route."""
    n = F.col("orders")
    return (
        present(_flags(orders, **_one_route(date, cnr_tour)), *ROUTE)
        .groupBy(*ROUTE)
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if("jit_s1_order").alias("s1"),
            F.count_if("jit_s2_order").alias("s2"),
        )
        .select(
            *ROUTE, "orders",
            percent(F.col("s1"), n).alias("s1_ord_pct"),
            percent(F.col("s2"), n).alias("s2_ord_pct"),
        )
    )


def route_detail_orders(
    orders: DataFrame, date: str | None = None, cnr_tour: str | None = None
) -> DataFrame:
    """Order lines of a route with display clocks and a grade.

    Sorted for one route; for all routes at once a sort of every order line would be one more
    shuffle of the whole table, so that form is left unsorted.
    """
    rows = present(_flags(orders, **_one_route(date, cnr_tour)), *ROUTE)
    if date and cnr_tour:
        rows = rows.orderBy(F.col("planned_ts").asc_nulls_last(), F.col("nm_short_unload").asc_nulls_last(), "row_ord")
    clocks = ("win_from", "win_until", "planned", "actual")
    return with_hhmm(rows, *clocks).select(
        *STOP, "rfx_activity", "rfx_year", "rfx_preparation", *clocks,
        "jit_s1_order", "jit_s2_order",
        row_grade(F.col("jit_s1_order"), F.col("jit_s2_order")).alias("row_grade"),
    )


def route_detail_deliveries(
    orders: DataFrame, date: str | None = None, cnr_tour: str | None = None
) -> DataFrame:
    """Deliveries of a route with display clocks and a grade; sorted for one route."""
    rows = _stops(orders, **_one_route(date, cnr_tour))
    if date and cnr_tour:
        rows = rows.orderBy(F.col("first_planned_ts").asc_nulls_last(), "nm_short_unload")
    clocks = ("win_from", "win_until", "first_planned", "first_actual")
    return with_hhmm(rows, *clocks).select(
        *STOP, "orders", *clocks,
        "jit_s1_delivery", "jit_s2_delivery",
        row_grade(F.col("jit_s1_delivery"), F.col("jit_s2_delivery")).alias("row_grade"),
    )
