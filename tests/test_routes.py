"""One plan orders the stops of all routes, built without running anything, and no result depends on row order."""

import re

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from conftest import TESTDATA
from punctual import fixture
from punctual.plans import rca, transport
from punctual.sources.schema import ORDER_COLUMNS


@pytest.fixture(scope="module")
def orders(spark):
    o = fixture.otif_orders(spark, f"{TESTDATA}/sf0.001").select(*ORDER_COLUMNS, "row_ord")
    # Few large routes: a month is one day, shops get a second part.
    return (
        o.withColumn("date_dos", F.concat(F.substring("date_dos", 1, 8), F.lit("01")))
        .withColumn("nm_short_unload", F.concat("nm_short_unload", F.lit("-"), F.col("rfx_preparation")))
        .cache()
    )


PLANS = [transport.transport_stops, transport.transport_routes, transport.transport_sequence, rca.rca_stop_sequence, rca.rca_route_decomposition]


@pytest.mark.parametrize("plan", PLANS)
def test_one_lazy_plan(spark, plan):
    """Building runs no job; one scan, no broadcast, and the shape does not depend on the data."""
    scan = fixture.otif_orders(spark, f"{TESTDATA}/sf0.001").select(*ORDER_COLUMNS, "row_ord")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", plan.__name__)
    df, alone = plan(scan), plan(scan.withColumn("cnr_tour", F.lit("1")))
    assert tracker.getJobIdsForGroup("building") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    shapes = [[n for n in re.findall(r"[:+*\-() \d]*(\w+)", x.split("[")[0])[:1]] for y in (df, alone) for x in [y._jdf.queryExecution().executedPlan().toString()]]
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Broadcast" not in text and shapes[0] == shapes[1]


def test_positions_are_permutations(orders):
    stops = transport.transport_stops(orders)
    n = stops.groupBy("date_dos", "cnr_tour").agg(
        F.count("*").alias("n"),
        *[F.sort_array(F.collect_list(c)).alias(c) for c in ("planned_pos", "actual_pos")],
    )
    expected = F.sequence(F.lit(1), F.col("n").cast("int"))
    assert n.where((F.col("planned_pos") != expected) | (F.col("actual_pos") != expected)).isEmpty()


@pytest.mark.parametrize("plan", [transport.transport_stops, rca.rca_stops])
def test_row_order_does_not_matter(orders, plan):
    shuffled = orders.repartition(5, F.rand(1))
    assert spark_rows(plan(shuffled)) == spark_rows(plan(orders))
