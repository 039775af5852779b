"""Planned against actual execution of a route: stop order, departure, time on site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from punctual.functions.clocks import minutes, with_clocks, with_hhmm
from punctual.functions.measures import total
from punctual.functions.text import stored_number
from punctual.operators import route_order
from punctual.operators.firsts import clock_value, first_clock, number_value, stops_with_activity
from punctual.sources.orders import select_orders
from punctual.sources.schema import ROUTE, STOP, present

_DEPARTS = ("p_depart", "a_depart")


def _stops(orders: DataFrame) -> DataFrame:
    """One row per stop, plus one per route for orders without shop.

    The row without shop is no stop, but the route takes its first activity and first departures
    from all its orders. Carrying these first values along keeps it to a single scan; they are
    pruned where only stops are asked for.
    """
    clocks, durations = ("planned", "actual", "a_depart"), ("duration_p", "duration_a")
    rows = with_clocks(present(orders, *ROUTE), *clocks)
    firsts = {c: (clock_value(rows, c), c) for c in ("p_depart", *clocks)} | {c: (number_value(rows, c), c) for c in durations}
    lows = [f"{c}_ts" for c in clocks]
    stops = stops_with_activity(rows, firsts, lows, {"orders": "cnr_cust"})
    stops = stops.select(
        *STOP, "rfx_activity", *clocks, *durations, *lows, "orders", F.col("first_activity").alias("activity_of_route"), "row_ord",
        *[F.col(c).alias(f"{c}_of_route") for c in _DEPARTS], *[f"{c}_ord" for c in _DEPARTS],
    )
    on_site = minutes("actual_ts", "a_depart_ts")
    return (
        with_hhmm(stops, "planned", "actual", "a_depart")
        .withColumns(
            {
                "planned_block_min": _number(stops, "duration_p"),
                "actual_block_min": F.coalesce(_number(stops, "duration_a"), on_site),
                "arrival_delta_min": minutes("planned_ts", "actual_ts"),
            }
        )
        .withColumn("delta_block_min", F.col("actual_block_min") - F.col("planned_block_min"))
    )


def _number(stops: DataFrame, name: str) -> Column:
    """A first duration as a number, which it is already where ingest stored numbers."""
    return F.col(name) if stops.schema[name].dataType.typeName() == "double" else stored_number(stops, name)


def _departure_delay(routes: DataFrame) -> DataFrame:
    """Adds the delay from the two departure clocks of a route, to the minute."""
    if all(routes.schema[c].dataType.typeName() == "long" for c in _DEPARTS):
        routes = routes.withColumns({f"{c}_sec": F.expr(f"CASE WHEN {c} >= 0 THEN {c} DIV 60 * 60 END") for c in _DEPARTS})
        routes = with_clocks(routes, *_DEPARTS).drop(*[f"{c}_sec" for c in _DEPARTS])
    else:
        routes = with_clocks(with_hhmm(routes, *_DEPARTS), *_DEPARTS)
    return routes.withColumn("dep_delay_min", minutes("p_depart_ts", "a_depart_ts")).drop(
        *_DEPARTS, *[f"{c}_ts" for c in _DEPARTS]
    )


def _placed(orders: DataFrame) -> DataFrame:
    """Stops with their place in the planned and in the actual order of the route."""
    stops = route_order.position(_stops(present(orders, *ROUTE)), "planned_ts", "planned_pos")
    stops = route_order.position(stops, "actual_ts", "actual_pos")
    return stops.withColumn("seq_delta", F.col("actual_pos") - F.col("planned_pos"))


def transport_stops(orders: DataFrame, **filters) -> DataFrame:
    """Stops with time on site and their place in the planned and in the actual order.

    Time on site falls back per stop to departure minus arrival. A stop never reached comes last in
    the actual order.
    """
    return present(_placed(select_orders(orders, **filters)), "nm_short_unload").select(
        *STOP, "rfx_activity", "planned_ts", "actual_ts", "a_depart_ts", "planned", "actual",
        "a_depart", "planned_block_min", "actual_block_min", "arrival_delta_min",
        "delta_block_min", "orders", "planned_pos", "actual_pos", "seq_delta",
    )


def transport_routes(orders: DataFrame, **filters) -> DataFrame:
    """Stop order, departure delay and total time on site per route, largest overrun first."""
    shop, shift = F.col("nm_short_unload").isNotNull(), F.abs("seq_delta")
    routes = _placed(select_orders(orders, **filters)).groupBy(*ROUTE).agg(
        F.min_by("activity_of_route", "row_ord").alias("rfx_activity"),
        F.count_if(shop).alias("leverpunten"),
        F.count_if(shop & (shift > 0)).alias("seq_mismatch_cnt"),
        F.coalesce(F.max(F.when(shop, shift)), F.lit(0)).alias("max_abs_seq_delta"),
        *[F.min_by(f"{c}_of_route", f"{c}_ord").alias(c) for c in _DEPARTS],
        total(F.when(shop, F.col("planned_block_min"))).alias("planned_block_total_min"),
        total(F.when(shop, F.col("actual_block_min"))).alias("actual_block_total_min"),
    )
    overrun = F.col("actual_block_total_min") - F.col("planned_block_total_min")
    return (
        _departure_delay(routes)
        .withColumn("delta_block_total_min", overrun)
        .orderBy("date_dos", F.desc("delta_block_total_min"), "cnr_tour")
    )


def _one_route(date: str | None, cnr_tour: str | None) -> dict:
    return {"date_from": date, "date_to": date, "cnr_tour": cnr_tour}


def transport_sequence(
    orders: DataFrame, date: str | None = None, cnr_tour: str | None = None
) -> DataFrame:
    """Planned and actual place of each stop; in planned order for one route."""
    rows = transport_stops(orders, **_one_route(date, cnr_tour))
    rows = rows.orderBy("planned_pos") if date and cnr_tour else rows
    return rows.select(*STOP, "planned", "actual", "planned_pos", "actual_pos", "seq_delta", "orders")


def transport_departure(
    orders: DataFrame, date: str | None = None, cnr_tour: str | None = None
) -> DataFrame:
    """Actual minus planned departure of a route, each from the first order that has one."""
    rows = present(select_orders(orders, **_one_route(date, cnr_tour)), *ROUTE)
    return _departure_delay(rows.groupBy(*ROUTE).agg(*[first_clock(rows, c).alias(c) for c in _DEPARTS]))


def transport_blocks(
    orders: DataFrame, date: str | None = None, cnr_tour: str | None = None
) -> DataFrame:
    """Planned and actual time on site per stop; largest overrun first for one route."""
    filters = select_orders(orders, **_one_route(date, cnr_tour))
    rows = present(_stops(filters), "nm_short_unload")
    if date and cnr_tour:
        rows = rows.orderBy(F.desc_nulls_last("delta_block_min"), "nm_short_unload")
    return rows.select(
        *STOP, "planned", "actual", "a_depart", "planned_block_min", "actual_block_min",
        "delta_block_min", "arrival_delta_min", "orders",
    )
