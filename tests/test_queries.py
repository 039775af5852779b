"""Every registered query against its SQL, and the plans it must have."""

import re

import pytest

import __spark_entry__ as registry
from punctual import oracle
from compare import duck_rows, spark_rows
from conftest import TESTDATA, duck

#: Those of the reports; the text operators have tests of their own.
QUERIES = {name: query for name, query in registry.queries().items() if name in oracle.oracle_sql()}
SF = "0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, f"{TESTDATA}/sf{SF}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan
    assert spark_rows(df) == duck_rows(con, registry.oracle_sql()[name])


@pytest.mark.parametrize(
    "name", ["routes_overview", "outside_daily", "outside_buckets_daily", "rca_customer_day", "window_summary"]
)
def test_reports_aggregate_by_hash(spark, name):
    """Numeric buffers only, so no sort of raw orders before the first shuffle."""
    df = QUERIES[name](spark, f"{TESTDATA}/sf{SF}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "partial_" in plan


def test_report_reads_needed_columns_only(spark):
    df = QUERIES["routes_overview"](spark, f"{TESTDATA}/sf{SF}")
    schema = df._jdf.queryExecution().executedPlan().toString().split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_extendedprice" not in schema and "l_linenumber" not in schema


def test_share_reuses_the_grouped_counts(spark):
    df = QUERIES["root_cause_segments"](spark, f"{TESTDATA}/sf{SF}")
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


#: Reports with clock texts or activities in their results.
WITH_TEXTS = [
    "stop_deliveries", "route_detail_deliveries", "outside_stops", "outside_points", "rca_stops", "rca_stop_sequence", "rca_detail",
    "transport_stops", "transport_routes", "transport_sequence", "transport_departure", "transport_blocks",
]


@pytest.mark.parametrize("name", WITH_TEXTS)
def test_raw_orders_are_combined_by_hash(spark, name):
    """Stops may be sorted for a text, orders are not."""
    plan = QUERIES[name](spark, f"{TESTDATA}/sf{SF}")._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"SortAggregate|HashAggregate|FileScan", plan)
    assert nodes.count("FileScan") == 1 and nodes[nodes.index("FileScan") - 1] == "HashAggregate"


def test_reports_read_no_clock_with_patterns(spark):
    """Ingest has read the clocks; what a report still shows are stored numbers."""
    for name in [*WITH_TEXTS, *[n for n in QUERIES if n.startswith("window_")], "routes_overview", "waits_by_store", "waits_by_delivery"]:
        plan = QUERIES[name](spark, f"{TESTDATA}/sf{SF}")._jdf.queryExecution().executedPlan().toString()
        assert "regexp" not in plan and "RLIKE" not in plan, name


def test_counts_of_two_kinds_of_distinct_value_need_no_second_copy_of_rows(spark):
    df = QUERIES["rca_customer_day"](spark, f"{TESTDATA}/sf{SF}")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "ReusedExchange" in plan.split("Initial Plan")[0]


def test_one_scan_tells_whether_there_is_a_delivery(spark):
    plan = QUERIES["window_wait_buckets"](spark, f"{TESTDATA}/sf{SF}")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
