"""The numbers that ingest reads out of clock and duration texts, and reports on them against reports on the texts."""

import re

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from conftest import TESTDATA
from punctual import fixture
from punctual.functions import clocks
from punctual.functions.text import number
from punctual.plans import jit, outside, rca, transport, waits, window_report
from punctual.sources import orders as ot
from punctual.sources.schema import CLOCK_COLUMNS, DURATION_COLUMNS, ORDER_COLUMNS, TYPED_COLUMNS


@pytest.fixture(scope="module")
def typed(spark):
    return fixture.otif_orders(spark, f"{TESTDATA}/sf0.001").select(*ORDER_COLUMNS, *TYPED_COLUMNS, "row_ord").cache()


def test_numbers_stand_for_the_texts(typed):
    for c in CLOCK_COLUMNS:
        assert typed.where(~F.col(f"{c}_sec").eqNullSafe(clocks.clock_seconds(c))).isEmpty(), c
    for c in DURATION_COLUMNS:
        assert typed.where(~F.col(f"{c}_num").eqNullSafe(number(c))).isEmpty(), c


@pytest.mark.parametrize(
    "plan",
    [
        jit.stop_order_flags, jit.stop_deliveries, jit.route_detail_orders, jit.route_detail_deliveries, outside.outside_stops, rca.rca_stops,
        rca.rca_stop_sequence, transport.transport_stops, transport.transport_routes, transport.transport_departure, transport.transport_blocks,
        waits.waits_by_delivery, waits.waits_store_orders, window_report.window_orders, window_report.window_wait_by_store,
    ],
)
def test_same_report_with_and_without_numbers(typed, plan):
    assert spark_rows(plan(typed)) == spark_rows(plan(typed.drop(*TYPED_COLUMNS)))


def test_codes_hold_clocks_and_short_odd_texts(spark):
    texts = ["00:00", "23:59", "08:30", "", "n/a", "24:00", "99:99", "nan", "später", None]
    rows = spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "actual string, k int")
    rows = rows.withColumn("actual_sec", clocks.clock_seconds("actual")).withColumn("code", F.expr(clocks.clock_code_sql("actual")))
    coded = rows.select("k", F.col("code").alias("actual"))
    assert [r.actual for r in clocks.with_texts(coded, "actual").orderBy("k").collect()] == texts
    shown = [r.actual for r in clocks.with_hhmm(coded, "actual").orderBy("k").collect()]
    assert shown == [r.actual for r in clocks.with_hhmm(rows.drop("actual_sec"), "actual").orderBy("k").collect()]


def test_ingest_writes_the_numbers(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "date_dos,cnr_tour,Planned,Actual,P_Depart,DurationA,DurationP\n2024-03-05,7,1900-01-01 08:05:00,6:30 PM,odd,12.5,x\n2024-03-05,7,,23:59,05:30,,7\n"
    )
    rows = ot.ingest_orders(spark, str(tmp_path / "in.csv"), str(tmp_path / "table")).orderBy("row_ord").collect()
    assert [(r.planned, r.planned_sec, r.actual_sec, r.p_depart_sec, r.duration_a_num, r.duration_p_num) for r in rows] == [
        ("08:05", 29100, 66600, None, 12.5, None), (None, None, 86340, 19800, None, 7.0)
    ]


_METHOD = re.compile(r"maxMethodCodeSize:(\d+)")


@pytest.mark.parametrize("name", ["ingest_orders", "route_detail_orders", "waits_store_orders", "root_cause_pareto", "root_cause_segments"])
def test_methods_are_compiled(spark, capsys, name):
    """The JVM interprets a method of more than 8,000 bytes for ever."""
    entry.queries()[name](spark, "/root/testdata/sf0.001").explain("codegen")
    sizes = [int(m) for m in _METHOD.findall(capsys.readouterr().out)]
    assert all(size < 8000 for size in sizes)


def test_clocks_of_all_forms(spark):
    forms = {
        "5:07": "05:07", "05:07": "05:07", "23:59:59": "23:59", "24:00": None, "12:60": None, "05:07:60": None, "5:07 pm": "17:07", "12:05 AM": "00:05",
        "13:05 PM": None, "1900-01-01 06:10:00": "06:10", "1900-02-30 06:10:00": None, "2024-1-2T6:10": "06:10", "01/02/2024 05:30": "05:30",
        "2 Jan 2024 5:30 p.m.": "17:30", "05:07:08.25": "05:07", "5:7": None, "n/a": None, "": None, "5:30 ": "05:30", "2024-01-02": None,
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(forms)], "k int, t string")
    got = [r["t"] for r in clocks.with_clock_text(rows, "t").orderBy("k").collect()]
    assert got == list(forms.values())


def test_instants_of_all_forms(spark):
    forms = {
        "2024-01-02 05:30": "2024-01-02 05:30:00", "2024-01-02T05:30:10": "2024-01-02 05:30:10", "2024-1-2 5:30": "2024-01-02 05:30:00",
        "2024-01-02 05:30Z": "2024-01-02 05:30:00", "2024-01-02 05:30+02:00": "2024-01-02 03:30:00", "2024-02-30 05:30": None,
        "2024-01-02 24:00": None, "2024-01-02 ": None, "2024-01-02": "2024-01-02 00:00:00", "05:30": None, None: None,
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(forms)], "k int, t string")
    got = [r["i"] for r in rows.withColumn("i", clocks.utc_instant(rows, "t").cast("string")).orderBy("k").collect()]
    assert got == list(forms.values())
