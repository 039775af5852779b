"""Window report with a tolerance, for the two retailers of interest.

A second definition of "delivery" and "on time", kept apart from ``jit``: a delivery is also keyed
by customer and window, and an order needs both window ends and an arrival to be on time at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from punctual.functions.clocks import is_typed, report_day, service_day, with_clocks_on
from punctual.functions.lookups import customer_label
from punctual.functions.measures import is_true, percent2, wait_bucket
from punctual.functions.text import id_text, stored_number
from punctual.operators.firsts import first_row
from punctual.sources.schema import ROUTE, present, require, with_optional

ACTIVITIES = ("4", "5")
DELIVERY = ["date_dos", "cnr_tour", "cnr_cust", "nm_short_unload", "win_from", "win_until"]

_REQUIRED = [*DELIVERY, "rfx_activity", "planned", "actual", "row_ord"]
_OPTIONAL = ["rfx_year", "rfx_preparation", "duration_p", "duration_a"]
_TEXTS = ["cnr_tour", "cnr_cust", "rfx_year", "rfx_preparation", "nm_short_unload"]
_CLOCKS = ["win_from", "win_until", "planned", "actual"]


def window_orders(orders: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    """Prepared orders: activity filter, parsed day and clocks, channel, both on-time flags."""
    return _orders(orders, tolerance_minutes).drop("wait_p", "wait_a")


def _orders(orders: DataFrame, tolerance_minutes: int) -> DataFrame:
    """The same, with both durations as numbers."""
    require(orders, _REQUIRED, "The window report needs")
    rows = with_optional(orders, *_OPTIONAL)
    # Ingest trims identifiers, so the column itself is compared and the filter reaches the scan.
    rows = rows.where(F.col("rfx_activity").isin(*ACTIVITIES))
    rows = rows.withColumn("date_dos", service_day(rows))
    rows = rows.withColumns({c: id_text(c) for c in _TEXTS})
    rows = with_clocks_on(rows, "date_dos", *_CLOCKS)
    waits = {"wait_p": stored_number(rows, "duration_p"), "wait_a": stored_number(rows, "duration_a")}
    slack = F.make_dt_interval(mins=F.lit(tolerance_minutes))
    actual, latest = F.col("actual_ts"), F.col("win_until_ts") + slack
    # The start is tested in both, so a missing one makes both false.
    return rows.withColumns(
        {
            "order_jit_s1": is_true((actual >= F.col("win_from_ts") - slack) & (actual <= latest)),
            "order_jit_s2": is_true((actual <= latest) & F.col("win_from_ts").isNotNull()),
            "kanaal": customer_label(F.col("cnr_cust"), "Overig"),
            **waits,
        }
    ).select(
        *DELIVERY, "rfx_activity", *_OPTIONAL, "planned", "actual", *[f"{c}_ts" for c in _CLOCKS],
        "order_jit_s1", "order_jit_s2", "kanaal", "row_ord", *waits,
    )


def _groups(orders: DataFrame) -> DataFrame:
    """Orders by delivery key, missing key parts kept so that order totals come from the same pass.

    The activity is a number here, which keeps the first-value aggregate in a hash aggregation.
    """
    return orders.groupBy(*DELIVERY).agg(
        F.count(F.lit(1)).alias("orders_total"),
        F.count_if("order_jit_s1").alias("orders_jit_s1"),
        F.count_if("order_jit_s2").alias("orders_jit_s2"),
        first_row("cast(rfx_activity AS int)").alias("_activity"),
    )


def window_deliveries(orders: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    """One row per delivery; it is on time if any of its orders is."""
    s1, s2 = F.col("orders_jit_s1") > 0, F.col("orders_jit_s2") > 0
    return present(_groups(window_orders(orders, tolerance_minutes)), *DELIVERY).select(
        *DELIVERY, "orders_total", "orders_jit_s1", "orders_jit_s2",
        s1.alias("any_jit_s1"), s2.alias("any_jit_s2"),
        F.col("_activity").cast("string").alias("rfx_activity"),
        customer_label(F.col("cnr_cust"), "Overig").alias("kanaal"),
        s1.alias("delivery_jit_s1"), s2.alias("delivery_jit_s2"),
    )


def _if_any_delivery(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table``, or no rows if there is no delivery at all: a scalar subquery, no action."""
    return table.where(rows.agg(F.count_if(_is_delivery())).scalar() > 0)


def _is_delivery() -> Column:
    return F.col("date_dos").isNotNull() & F.col("win_from").isNotNull() & F.col("win_until").isNotNull()


def _totals(groups: DataFrame, *keys: str) -> DataFrame:
    """Delivery and order counts of grouped orders."""
    d = _is_delivery()
    return groups.groupBy(*keys).agg(
        F.count_if(d).alias("leveringen_totaal"),
        F.count_if(d & (F.col("orders_jit_s1") > 0)).alias("leveringen_jit_s1"),
        F.count_if(d & (F.col("orders_jit_s2") > 0)).alias("leveringen_jit_s2"),
        F.sum("orders_total").alias("orders_totaal"),
        F.sum("orders_jit_s1").alias("orders_jit_s1"),
        F.sum("orders_jit_s2").alias("orders_jit_s2"),
    )


def _delivery_rates(df: DataFrame) -> DataFrame:
    n = F.col("leveringen_totaal")
    return df.withColumns(
        {f"jit_pct_lev_{s}": percent2(F.col(f"leveringen_jit_{s}"), n) for s in ("s1", "s2")}
    )


def window_summary(orders: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    """One row for the whole report; none if there is no delivery.

    Orders with an unreadable day or without a window count as orders but not as deliveries.
    """
    t = _totals(_groups(window_orders(orders, tolerance_minutes))).where("leveringen_totaal > 0")
    orders_n, deliveries_n = F.col("orders_totaal"), F.col("leveringen_totaal")
    return t.select(
        orders_n.alias("totaal_orders"),
        F.col("orders_jit_s1").alias("jit_orders_s1"),
        F.col("orders_jit_s2").alias("jit_orders_s2"),
        percent2(F.col("orders_jit_s1"), orders_n).alias("jit_pct_orders_s1"),
        percent2(F.col("orders_jit_s2"), orders_n).alias("jit_pct_orders_s2"),
        deliveries_n.alias("totaal_leveringen"),
        F.col("leveringen_jit_s1").alias("jit_leveringen_s1"),
        F.col("leveringen_jit_s2").alias("jit_leveringen_s2"),
        percent2(F.col("leveringen_jit_s1"), deliveries_n).alias("jit_pct_leveringen_s1"),
        percent2(F.col("leveringen_jit_s2"), deliveries_n).alias("jit_pct_leveringen_s2"),
    )


def window_daily_overview(orders: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    """Deliveries and orders per day.

    A day with orders but no delivery has zero deliveries: both counts come from one aggregation that
    keeps incomplete keys, instead of an outer join of two.
    """
    groups = _groups(window_orders(orders, tolerance_minutes))
    days = _if_any_delivery(_delivery_rates(_totals(present(groups, "date_dos"), "date_dos")), groups)
    n = F.col("orders_totaal")
    return days.withColumns(
        {f"jit_pct_ord_{s}": percent2(F.col(f"orders_jit_{s}"), n) for s in ("s1", "s2")}
    ).orderBy("date_dos")


def _by(orders: DataFrame, tolerance_minutes: int, *keys: str) -> DataFrame:
    return window_deliveries(orders, tolerance_minutes).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("leveringen_totaal"),
        F.count_if("delivery_jit_s1").alias("leveringen_jit_s1"),
        F.count_if("delivery_jit_s2").alias("leveringen_jit_s2"),
    )


def window_by_activity(orders: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    return _delivery_rates(_by(orders, tolerance_minutes, "rfx_activity")).orderBy("rfx_activity")


def window_by_channel(orders: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    """Per channel, largest first."""
    rows = _delivery_rates(_by(orders, tolerance_minutes, "kanaal"))
    return rows.orderBy(F.desc("leveringen_totaal"), "kanaal")


def window_bottom_routes(orders: DataFrame, tolerance_minutes: int = 0, limit: int = 10) -> DataFrame:
    """Routes with the lowest delivery rate; equal ones by day and tour."""
    rows = _delivery_rates(_by(orders, tolerance_minutes, *ROUTE))
    return (
        rows.select(*ROUTE, "leveringen_totaal", "leveringen_jit_s2", "jit_pct_lev_s2")
        .orderBy("jit_pct_lev_s2", *ROUTE)
        .limit(limit)
    )


def window_impact_stores(orders: DataFrame, tolerance_minutes: int = 0, limit: int = 15) -> DataFrame:
    """Shops with the most late deliveries; equal ones by share, then name."""
    late = F.col("leveringen_totaal") - F.col("leveringen_jit_s2")
    return (
        _by(orders, tolerance_minutes, "nm_short_unload")
        .select(
            F.col("nm_short_unload").alias("winkelpunt"), "leveringen_totaal",
            late.alias("non_jit_leveringen"),
            percent2(late, F.col("leveringen_totaal")).alias("non_jit_pct"),
        )
        .orderBy(F.desc("non_jit_leveringen"), F.desc("non_jit_pct"), "winkelpunt")
        .limit(limit)
    )


def _late_or_not(orders: DataFrame, tolerance_minutes: int) -> DataFrame:
    """Orders with their extra wait. All of them: whether there is any delivery is told by the same aggregation."""
    return _orders(orders, tolerance_minutes).withColumn("extra", F.col("wait_a") - F.col("wait_p"))


def window_wait_buckets(orders: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    """Late orders by extra wait, with shares."""
    late = ~F.col("order_jit_s2")
    groups = (
        _late_or_not(orders, tolerance_minutes)
        .groupBy(F.when(late, wait_bucket(F.col("extra"))).alias("rootcause_bucket"))
        .agg(F.count_if(late).alias("aantal"), F.count_if(_is_delivery()).alias("deliveries"))
    )
    # A handful of rows, one per bucket and one for orders on time.
    whole = Window.partitionBy()
    totals = {"all_late": F.sum("aantal").over(whole), "any": F.sum("deliveries").over(whole)}
    counts = groups.withColumns(totals).where("aantal > 0 AND any > 0")
    share = percent2(F.col("aantal"), F.col("all_late"))
    return counts.select("rootcause_bucket", "aantal", share.alias("aandeel_pct")).orderBy(F.desc("aantal"), "rootcause_bucket")


def window_wait_by_store(orders: DataFrame, tolerance_minutes: int = 0, limit: int = 15) -> DataFrame:
    """Shops with the most late orders and their mean waits."""
    means = {
        "avg_duration_p_min": "wait_p",
        "avg_duration_a_min": "wait_a",
        "avg_extra_wachttijd_min": "extra",
    }
    late = ~F.col("order_jit_s2")
    groups = (
        _late_or_not(orders, tolerance_minutes)
        .groupBy("nm_short_unload")
        .agg(
            F.count_if(late).alias("late_orders"),
            *[F.bround(F.avg(F.when(late, F.col(c))), 1).alias(name) for name, c in means.items()],
            F.count_if(_is_delivery()).alias("deliveries"),
        )
    )
    # The guard is a second, narrow scan: one total over all shops would need them in one task.
    stores = groups.where(groups.agg(F.sum("deliveries")).scalar() > 0)
    return (
        stores.where("late_orders > 0")
        .drop("deliveries")
        .orderBy(F.desc("late_orders"), F.desc_nulls_last("avg_extra_wachttijd_min"), "nm_short_unload")
        .limit(limit)
    )


def _of_route(orders: DataFrame, date_dos: str | None, cnr_tour: str | None) -> DataFrame:
    """The route filter, on plain columns as ingest leaves them, so that it reaches the scan.

    In a frame that ingest has not written, days other than ISO text are still parsed, behind the plain test.
    """
    if date_dos and is_typed(orders, "win_from"):
        orders = orders.where(F.col("date_dos") == date_dos)
    elif date_dos:
        iso = F.col("date_dos") == date_dos
        orders = orders.where(iso | (~F.col("date_dos").rlike(r"^\d{4}-\d{2}-\d{2}$") & (report_day("date_dos") == F.lit(date_dos).cast("date"))))
    if cnr_tour:
        orders = orders.where(F.col("cnr_tour") == str(cnr_tour))
    return orders


def window_route_detail_orders(
    orders: DataFrame,
    date_dos: str | None = None,
    cnr_tour: str | None = None,
    tolerance_minutes: int = 0,
) -> DataFrame:
    """Order lines of a route, sorted; or of all routes."""
    require(orders, _REQUIRED, "The window report needs")
    rows = present(window_orders(_of_route(orders, date_dos, cnr_tour), tolerance_minutes), "date_dos")
    if date_dos and cnr_tour:
        rows = rows.orderBy("nm_short_unload", F.asc_nulls_last("actual"), "row_ord")
    return rows.select(
        *ROUTE, "cnr_cust", "rfx_activity", "kanaal", "nm_short_unload", *_CLOCKS,
        "order_jit_s1", "order_jit_s2",
    )


def window_route_detail_deliveries(
    orders: DataFrame,
    date_dos: str | None = None,
    cnr_tour: str | None = None,
    tolerance_minutes: int = 0,
) -> DataFrame:
    """Deliveries of a route, sorted; or of all routes."""
    require(orders, _REQUIRED, "The window report needs")
    rows = window_deliveries(_of_route(orders, date_dos, cnr_tour), tolerance_minutes)
    if date_dos and cnr_tour:
        rows = rows.orderBy("nm_short_unload", "win_from", "cnr_cust", "win_until")
    return rows.select(
        *ROUTE, "cnr_cust", "kanaal", "nm_short_unload", "win_from", "win_until",
        "orders_total", "orders_jit_s1", "orders_jit_s2", "delivery_jit_s1", "delivery_jit_s2",
    )


def window_report(orders: DataFrame, tolerance_minutes: int = 0) -> dict[str, DataFrame]:
    """All tables of the report, each evaluated only when used."""
    # The names under which callers look the tables up.
    tables = {
        "summary": window_summary,
        "daily_overview": window_daily_overview,
        "by_rfx_activity": window_by_activity,
        "by_channel": window_by_channel,
        "bottom_routes": window_bottom_routes,
        "impact_stores": window_impact_stores,
        "root_cause_buckets": window_wait_buckets,
        "late_wait_by_store": window_wait_by_store,
    }
    return {name: build(orders, tolerance_minutes) for name, build in tables.items()}
