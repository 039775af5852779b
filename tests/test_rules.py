"""Hand-made rows for each rule; expected values worked out by hand."""

import pytest
from pyspark.sql import functions as F, types as T

from punctual.functions import clocks, measures, text
from punctual.plans import jit, kpi, outside, rca, root_cause, transport, waits, window_report
from punctual.sources import deliveries as dt, orders as ot
from punctual.sources.schema import ORDERS_SCHEMA

BASE = {
    "date_dos": "2024-03-05", "cnr_tour": "7", "cnr_cust": "Z41102", "rfx_activity": "4", "rfx_year": "1",
    "rfx_preparation": "1", "nm_short_unload": "A", "win_from": "08:00", "win_until": "09:00",
    "planned": "08:30", "actual": "08:30", "p_depart": "05:30", "a_depart": "08:40", "duration_p": "10",
    "duration_a": "10",
}


def orders(spark, *rows):
    data = [{**BASE, **r, "row_ord": i} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(d[n] for n in ORDERS_SCHEMA.names) for d in data], ORDERS_SCHEMA)


def values(df, *names):
    out = [tuple(r) for r in df.select(*names).collect()]
    return [r[0] for r in out] if len(names) == 1 else out


def texts(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "x string, i int")


def test_window_edges(spark):
    o = orders(spark, *[{"actual": a} for a in ("07:59", "08:00", "09:00", "09:01")])
    assert values(jit.stop_order_flags(o), "jit_s1_order", "jit_s2_order") == [
        (False, True), (True, True), (True, True), (False, False)]
    w = window_report.window_orders(o, 1)
    assert values(w, "order_jit_s1", "order_jit_s2") == [(True, True)] * 4
    assert values(window_report.window_orders(o), "order_jit_s1") == [False, True, True, False]


def test_clock_forms(spark):
    df = texts(spark, "6:05", "06:05", "06:05:09", "24:00", "", "n/a", "6", None)
    got = values(df.select(clocks.clock_ts("'2024-03-05'", "x").alias("t")), "t")
    assert [g and g.strftime("%H:%M:%S") for g in got] == [
        "06:05:00", "06:05:00", "06:05:09", None, None, None, None, None]
    shown = values(clocks.with_hhmm(df, "x"), "x")
    assert shown == ["06:05", "06:05", "06:05", "24:00", "", "n/a", "6", ""]


def test_numbers(spark):
    df = texts(spark, " 7 ", "1,5", "1.0d", "inf", "-2.5e1", ".5", "", None)
    assert values(df.select(text.number("x").alias("n")), "n") == [7.0, None, None, None, -25.0, 0.5, None, None]


def test_late_sense_needs_start_only_in_window_report(spark):
    o = orders(spark, {"win_from": None})
    assert values(jit.stop_order_flags(o), "jit_s2_order") == [True]
    assert values(window_report.window_orders(o), "order_jit_s2") == [False]


def test_any_order_makes_the_delivery(spark):
    o = orders(spark, {}, {"actual": "10:00"})
    assert values(jit.stop_deliveries(o), "orders", "jit_s2_delivery") == [(2, True)]
    r = jit.routes_overview(o)
    assert values(r, "deliveries", "jit_s2_del", "orders", "jit_s2_ord", "jit_s2_ord_pct", "route_grade") == [
        (1, 1, 2, 1, 50.0, "good")]


def test_route_parameters(spark):
    o = orders(spark, {}, {"cnr_tour": "8"})
    assert values(jit.routes_overview(o, route_input=" 8 ", route_select="7"), "cnr_tour") == ["8"]
    assert values(jit.routes_overview(o, route_select="ALL"), "cnr_tour") == ["7", "8"]
    assert values(ot.select_orders(o, "2024-03-05", "2024-03-05", "4", "7"), "row_ord") == [0]


def test_orders_without_shop_count_for_the_route_only(spark):
    o = orders(spark, {"nm_short_unload": None})
    assert values(jit.routes_overview(o), "deliveries", "orders", "jit_s2_del_pct", "route_grade") == [
        (0, 1, 0.0, "bad")]
    assert values(jit.stop_deliveries(o), "orders") == []
    assert values(rca.rca_stops(o), "nm_short_unload") == ["nan"]
    t = transport.transport_routes(o)
    assert values(t, "leverpunten", "max_abs_seq_delta", "planned_block_total_min") == [(0, 0, 0.0)]


def test_outside_is_not_the_opposite_of_on_time(spark):
    o = orders(spark, {"actual": "09:30"}, {"win_until": "10:00", "actual": "09:40"})
    assert values(jit.stop_deliveries(o), "jit_s2_delivery") == [True]
    assert values(outside.outside_stops(o), "outside_s2", "late_minutes") == [(True, 30.0)]


def test_unknown_lateness(spark):
    o = orders(spark, {"actual": None})
    assert values(outside.outside_stops(o), "outside_s2", "late_minutes", "actual") == [(True, None, "")]
    assert values(outside.outside_buckets_daily(o), "unknown", "cnt_0_15") == [(1, 0)]
    assert values(rca.rca_stops(o), "late_min", "late_bucket") == [(None, "unknown")]


def test_bucket_edges(spark):
    x = spark.createDataFrame([(v,) for v in (15.0, 15.5, 30.0, 45.0, 60.0, 61.0)], "x double")
    assert values(x.select(measures.outside_bucket(F.col("x")).alias("b")), "b") == [
        "0-15", "15-30", "15-30", "30-45", "45-60", "60+"]
    x = spark.createDataFrame([(v,) for v in (0.0, 15.0, 30.0, 60.0, 61.0, None)], "x double")
    assert values(x.select(measures.late_bucket(F.col("x")).alias("b")), "b") == [
        "0", "0–15", "15–30", "30–60", "60+", "unknown"]
    x = spark.createDataFrame([(v,) for v in (31.0, 30.0, 10.0, 0.0, -1.0, None)], "x double")
    assert [v.split()[0] for v in values(x.select(measures.wait_bucket(F.col("x")).alias("b")), "b")] == [
        "Ernstige", "Matige", "Lichte", "Lichte", "Geen", "Onbekend"]


def test_day_without_outside_stop(spark):
    o = orders(spark, {}, {"date_dos": "2024-03-06", "actual": "09:10"})
    assert values(outside.outside_buckets_daily(o), "date_dos") == ["2024-03-06"]
    assert values(outside.outside_daily(o), "leverpunten_outside") == [0, 1]
    assert values(outside.outside_buckets_daily(orders(spark, {})), "date_dos") == []


def test_cumulative_share(spark):
    arrivals = ["08:30"] * 6 + ["09:10"] * 2 + ["10:30", None]
    o = orders(spark, *[{"nm_short_unload": str(i), "actual": a} for i, a in enumerate(arrivals)])
    tags = ["0_15", "15_30", "30_45", "45_60", "60_plus"]
    row = outside.outside_buckets_daily(o).first()
    assert row["huidige_jit_pct"] == 60.0
    assert [row[f"jit_pct_cumul_{t}"] for t in tags] == [80.0, 80.0, 80.0, 80.0, 90.0]


def test_shop_on_two_routes(spark):
    o = orders(spark, {"actual": "09:30"}, {"actual": "09:30", "cnr_tour": "8"})
    assert values(outside.outside_daily(o), "leverpunten", "leverpunten_outside", "outside_pct") == [(1, 2, 200.0)]


def test_two_kinds_of_first(spark):
    o = orders(spark, {"a_depart": None}, {"a_depart": "08:00"})
    assert values(transport.transport_stops(o), "a_depart") == ["08:00"]
    assert values(rca.rca_stops(o), "a_depart", "a_depart_ts") == [("", None)]


def test_time_on_site(spark):
    o = orders(spark, {"duration_a": None, "actual": "08:00", "a_depart": "08:20"})
    assert values(rca.rca_stops(o), "wait_min") == [None]
    assert values(rca.rca_stops(o, has_duration_a=False), "wait_min") == [20.0]
    assert values(transport.transport_stops(o), "actual_block_min", "delta_block_min") == [(20.0, 10.0)]
    assert values(rca.rca_customer_day(o), "total_wait_min") == [0.0]


def test_stop_order(spark):
    plan = {"A": ("08:00", "10:00"), "B": ("09:00", "08:00"), "C": ("10:00", "09:00")}
    o = orders(spark, *[{"nm_short_unload": s, "planned": p, "actual": a} for s, (p, a) in plan.items()])
    assert sorted(values(transport.transport_sequence(o), "nm_short_unload", "seq_delta")) == [
        ("A", 2), ("B", -1), ("C", -1)]
    assert values(transport.transport_routes(o), "seq_mismatch_cnt", "max_abs_seq_delta") == [(3, 2)]
    never = orders(spark, *[
        {"nm_short_unload": s, "planned": p, "actual": None if s == "B" else a} for s, (p, a) in plan.items()])
    assert sorted(values(transport.transport_sequence(never), "nm_short_unload", "actual_pos")) == [
        ("A", 2), ("B", 3), ("C", 1)]


def test_departure(spark):
    o = orders(spark, {"a_depart": None}, {"p_depart": "x", "a_depart": "05:50"})
    assert values(transport.transport_departure(o), "dep_delay_min") == [20.0]
    assert values(transport.transport_routes(o), "dep_delay_min") == [20.0]
    o = orders(spark, {"p_depart": "x"}, {"p_depart": "05:30"})
    assert values(transport.transport_departure(o), "dep_delay_min") == [None]


def test_first_stop_of_a_route(spark):
    one = orders(spark, {})
    assert values(rca.rca_route_decomposition(one), "stops") == []
    two = orders(spark, {}, {"nm_short_unload": "B", "planned": "09:00", "actual": "09:20", "rfx_activity": "5"})
    # Leaves A at 08:40, planned there 08:30; 40 minutes on the road against 30 planned.
    names = ["rfx_activity", "stops", "sum_late_depart_proxy_min", "sum_transit_delay_min"]
    assert values(rca.rca_route_decomposition(two), *names) == [("5", 1, 10.0, 10.0)]


def test_waits(spark):
    o = orders(spark, {"duration_a": "x"}, {"duration_a": "10"}, {"duration_a": "20"}, {"cnr_tour": "8", "duration_a": "5"})
    names = ["rfx_activity", "deliveries", "leverpunten", "total_wait_min", "avg_wait_per_delivery"]
    assert values(waits.waits_by_customer(o), *names) == [("4", 2, 1, 20.0, 10.0)]
    assert values(waits.waits_by_store(o, rfx_activity="4"), "deliveries", "total_wait_min") == [(2, 20.0)]
    assert values(waits.waits_store_orders(o, "4", "A"), "duration_a_min") == [10.0, 20.0, 5.0]


def test_window_report_keys(spark):
    o = orders(
        spark, {"nm_short_unload": None}, {"win_until": None}, {"date_dos": None}, {"rfx_activity": "5"},
        {"rfx_activity": "3"}, {"date_dos": "05/03/2024"},
    )
    s = window_report.window_summary(o).first()
    assert (s.totaal_orders, s.totaal_leveringen) == (5, 2)
    day = window_report.window_daily_overview(o).collect()
    assert [(str(r.date_dos), r.leveringen_totaal, r.orders_totaal) for r in day] == [("2024-03-05", 2, 4)]
    shops = {r.winkelpunt for r in window_report.window_impact_stores(o).collect()}
    assert shops == {"nan", "A"}
    only_orders = orders(spark, {"win_until": None})
    assert window_report.window_summary(only_orders).count() == 0
    with pytest.raises(ValueError, match="planned"):
        window_report.window_orders(o.drop("planned"))


def test_window_rounding_and_ties(spark):
    rows = [{"cnr_cust": str(i), "actual": "08:30" if i == 0 else "10:00"} for i in range(32)]
    assert values(window_report.window_by_activity(orders(spark, *rows)), "jit_pct_lev_s2") == [3.12]
    rows = [{"cnr_tour": f"{i:02d}"} for i in range(11)]
    routes = window_report.window_bottom_routes(orders(spark, *reversed(rows)))
    assert values(routes, "cnr_tour") == [f"{i:02d}" for i in range(10)]


def test_window_route_detail(spark):
    o = orders(spark, {}, {"cnr_tour": "8"}, {"date_dos": "2024-03-06"})
    assert window_report.window_route_detail_orders(o, "2024-03-05", "7").count() == 1
    assert window_report.window_route_detail_deliveries(o, "2024-03-05").count() == 2
    assert set(window_report.window_report(o)) == {
        "summary", "daily_overview", "by_rfx_activity", "by_channel", "bottom_routes", "impact_stores",
        "root_cause_buckets", "late_wait_by_store"}


def deliveries(spark, *times, **columns):
    rows = [(p, a, *columns.values(), k) for k, (p, a) in enumerate(times)]
    fields = [T.StructField(n, T.StringType()) for n in ("planned_time", "actual_time", *columns)]
    return spark.createDataFrame(rows, T.StructType([*fields, T.StructField("row_ord", T.LongType())]))


def test_kpi(spark):
    p = "2024-03-05 08:00"
    d = deliveries(spark, (p, p), (p, "2024-03-05 08:05"), (p, "2024-03-05T07:00:00"), (p, None))
    assert values(kpi.kpi_rows(d), "on_time") == [True, False, True, False]
    assert values(kpi.kpi_overall(d), "orders", "on_time", "kpi_pct") == [(4, 2, 50.0)]
    assert values(kpi.kpi_overall(d.limit(0)), "orders", "on_time", "kpi_pct") == [(0, 0, 0.0)]
    zones = deliveries(spark, (p, "2024-03-05 09:00+01:00"), (p, "2024-03-05T08:00:00Z"), (p, "2024-03-05 10:00+0100"))
    assert values(kpi.kpi_rows(zones), "on_time") == [True, True, False]


def test_delay_classes(spark):
    def tour(*delays):
        return deliveries(
            spark, *[(f"2024-03-05 0{i}:00", None if d is None else f"2024-03-05 0{i}:{d:02d}") for i, d in enumerate(delays)],
            cnr_tour="7")

    def cluster(*delays):
        return values(kpi.route_delay_clusters(tour(*delays)), "root_cause_cluster")[0]

    assert cluster(11) == "Planning/Dispatch"
    assert cluster(5, 16) == "Sequencing / Route design"
    assert cluster(10, 15) == "Stable / On time"
    assert cluster(None) == "Stable / On time"
    names = ["stops", "start_delay", "end_delay", "avg_delay", "max_delay"]
    assert values(kpi.route_delay_clusters(tour(None, 4, 8, None)), *names) == [(4, 4.0, 8.0, 6.0, 8.0)]


def late(spark, *reasons):
    return spark.createDataFrame([(False, r) for r in reasons], "on_time boolean, reason string")


def test_root_causes(spark):
    p = root_cause.root_cause_pareto(late(spark, "picking_delay", "zzz", "", None))
    assert values(p, "reason_bucket", "count", "share_pct") == [
        ("Unknown", 2, 50.0), ("Operations/Picking", 1, 25.0), ("Other", 1, 25.0)]
    assert root_cause.root_cause_pareto(late(spark, "zzz").where("on_time")).count() == 0
    s = root_cause.root_cause_segments(late(spark, "zzz", "y").withColumn("customer", F.when(F.col("reason") == "y", "c")))
    assert values(s, "customer", "count", "share_pct") == [("c", 1, 100.0)]
    with pytest.raises(ValueError):
        root_cause.root_cause_pareto(spark.range(1))


def test_action_plan(spark):
    p = root_cause.root_cause_pareto(late(spark, "insufficient_stock", "zzz"))
    plan = root_cause.action_plan(p, 95.0)
    assert values(plan, "oorzaak_cluster", "impact_pct_pts") == [("Inventory", 2.0), ("Other", 1.5)]
    assert values(root_cause.action_plan(p, 99.0), "impact_pct_pts") == [0.0, 0.0]


def test_customers(spark):
    d = spark.createDataFrame([("Z41105",), ("x",), (None,)], "customer string")
    assert values(kpi.customer_labels(d), "customer_label") == ["Super / MKTI", "", ""]
    assert values(kpi.customer_labels(d, "nope"), "customer_label") == ["", "", ""]
    assert values(kpi.allowed_customers(d), "customer") == ["Z41105"]
    assert kpi.allowed_customers(d, "nope").count() == 0


def test_ingest(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text(
        " date_dos ,cnr_tour,cnr_cust,RFX Activity,nm_short_unload,Win FROM,Win UNTIL,Planned,Actual,duration_A\n"
        "2024-03-05 00:00:00,776907.0, Z1 ,,A,6:00,06:30:00,1900-01-01 06:10:00,24:00,12\n"
        "03/06/2024,8,Z2,4,,08:00,,x,08:10,\n"
        "later,8,Z2,4,B,08:00,09:00,08:00,08:10,\n"
    )
    path = str(tmp_path / "orders")
    assert ot.read_orders(spark, path).count() == 0
    for _ in range(2):
        o = ot.ingest_orders(spark, str(source), path)
    assert o.count() == 3 and o.schema["date_dos"].dataType == T.StringType()
    a, b, c = o.orderBy("row_ord").collect()
    assert (a.date_dos, a.cnr_tour, a.cnr_cust, a.rfx_activity, a.rfx_year) == ("2024-03-05", "776907", "Z1", "nan", "nan")
    assert (a.win_from, a.win_until, a.planned, a.actual, a.duration_a) == ("06:00", "06:30", "06:10", None, "12")
    assert (b.date_dos, b.nm_short_unload, b.planned, b.duration_p) == ("2024-03-06", None, None, None)
    assert c.date_dos is None
    assert ot.select_orders(o, cnr_tour="776907").count() == 1
    assert ot.select_orders(o, "2024-03-05", "2024-03-05").count() == 1
    assert values(ot.orders_preview(o, limit=2), "cnr_tour") == ["776907", "8"]
    assert values(ot.route_options(o), "cnr_tour") == ["776907", "8"]
    plan = ot.select_orders(o, "2024-03-05", "2024-03-05", "4")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_dos" in plan and "EqualTo(rfx_activity,4)" in plan


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "deliveries")
    batch = spark.createDataFrame(
        [("u", "1", "2024-03-05", 0), ("u", "2", "2024-03-05", 1), ("v", "3", "2024-03-06", 2),
         (None, "4", "2024-03-05", 3), (None, "5", "2024-03-05", 4)],
        "uid string, cnr_tour string, date_dos string, row_ord long",
    )
    first = dt.append_deliveries(spark, path, batch)
    assert sorted(values(first, "cnr_tour")) == ["1", "3", "4", "5"]
    named = batch.where("uid IS NOT NULL")
    assert dt.append_deliveries(spark, path, named).count() == 4
    table = dt.read_deliveries(spark, path)
    assert dt.scan_deliveries(table, "2024-03-05", "2024-03-05").count() == 0
    assert dt.scan_deliveries(table, "2024-03-05", "2024-03-06").count() == 3
    assert table.where("created_at IS NULL OR updated_at IS NOT NULL").isEmpty()


def test_lenient_days_and_clocks(spark):
    df = texts(
        spark, "02.01.2024", "13.01.2024", "2 Jan 2024", "January 5, 2024", "13/01/2024", "01/02/2024 06:30", "2 Foo 2024", "31.02.2024", None,
    )
    assert values(df.select(clocks.day_text("x").alias("d")), "d") == [
        "2024-02-01", "2024-01-13", "2024-01-02", "2024-01-05", "2024-01-13", "2024-01-02", None, None, None]
    df = texts(
        spark, "6:30 PM", "06:30 AM", "12:05 am", "12:05 PM", "01/02/2024 06:30", "2 Jan 2024 6:05 PM", "2024-01-02T06:30:00", "2024-13-02 06:30",
        "13:30 PM", "24:00", "noon", "x 6:30", "6:30", None,
    )
    assert values(clocks.with_clock_text(df, "x"), "x") == [
        "18:30", "06:30", "00:05", "12:05", "06:30", "18:05", "06:30", None, None, None, None, None, "06:30", None]
    assert values(clocks.with_hhmm(texts(spark, "6:30 PM", "06:30 PM", "n/a"), "x"), "x") == ["18:30", "06:30", "n/a"]
