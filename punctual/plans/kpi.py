"""On-time KPI of single deliveries: actual at most ``tolerance`` minutes after planned."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.functions.clocks import utc_instant
from punctual.functions.lookups import CUSTOMER_LABELS, customer_label
from punctual.functions.measures import delay_class, is_true, percent
from punctual.sources.schema import present, require, with_optional

_INSTANTS = ["planned_time", "actual_time", "dispatch_time", "cutoff_time"]
_MICROS_PER_MINUTE = 60e6


def _with_instants(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: utc_instant(rows, c) for c in _INSTANTS if c in rows.columns})


def _delay_min():
    micros = F.timestamp_diff("MICROSECOND", F.col("planned_time"), F.col("actual_time"))
    return micros / F.lit(_MICROS_PER_MINUTE)


def kpi_rows(rows: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    """Input rows with parsed instants and ``on_time``; early is on time, unknown is not."""
    rows = _with_instants(with_optional(rows, "planned_time", "actual_time"))
    return rows.withColumn("on_time", is_true(_delay_min() <= tolerance_minutes))


def kpi_overall(rows: DataFrame, tolerance_minutes: int = 0) -> DataFrame:
    """Count, on-time count and rate; 0, 0 and 0.0 without rows."""
    counts = kpi_rows(rows, tolerance_minutes).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("on_time").alias("on_time")
    )
    return counts.withColumn("kpi_pct", F.bround(percent(F.col("on_time"), F.col("orders")), 2))


def kpi_by_group(rows: DataFrame, groupby: list[str], tolerance_minutes: int = 0) -> DataFrame:
    """Count and rate per group; rows with a missing key are left out."""
    groups = present(kpi_rows(rows, tolerance_minutes), *groupby).groupBy(*groupby)
    counts = groups.agg(F.count(F.lit(1)).alias("orders"), F.count_if("on_time").alias("on_time"))
    rate = F.bround(percent(F.col("on_time"), F.col("orders")), 2)
    return counts.select(*groupby, "orders", rate.alias("kpi_pct"))


def route_delay_clusters(rows: DataFrame) -> DataFrame:
    """First, last, mean and largest delay of a tour in planned order, and its class.

    Rows without a delay count as stops but give no first or last delay.
    """
    require(rows, ["cnr_tour", "planned_time", "actual_time", "row_ord"], "Route delays cannot be computed without")
    delays = _with_instants(present(rows, "cnr_tour")).withColumn("delay", _delay_min())
    # Where there is a delay there is a planned time, so missing ones need no place in the order. Rows of one tour
    # and planned time are combined by place first; numbers as order keys keep both steps hash aggregations.
    place = F.when(F.col("delay").isNotNull(), F.col("row_ord"))
    at_time = delays.groupBy("cnr_tour", "planned_time").agg(
        F.count(F.lit(1)).alias("rows"), F.count("delay").alias("n"), F.sum("delay").alias("total"), F.max("delay").alias("largest"),
        F.min_by("delay", place).alias("first"), F.max_by("delay", place).alias("last"),
    )
    when = F.when(F.col("n") > 0, F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("planned_time")))
    return (
        at_time.groupBy("cnr_tour")
        .agg(
            F.sum("rows").alias("stops"),
            F.min_by("first", when).alias("start_delay"),
            F.max_by("last", when).alias("end_delay"),
            (F.sum("total") / F.sum("n")).alias("avg_delay"),
            F.max("largest").alias("max_delay"),
        )
        .withColumn("root_cause_cluster", delay_class(F.col("start_delay"), F.col("max_delay")))
        .orderBy("cnr_tour")
    )


def customer_labels(rows: DataFrame, key_col: str = "customer") -> DataFrame:
    """Adds ``customer_label``: blank for an unknown customer or an absent column."""
    label = customer_label(F.col(key_col), "") if key_col in rows.columns else F.lit("")
    return rows.withColumn("customer_label", label)


def allowed_customers(rows: DataFrame, key_col: str = "customer") -> DataFrame:
    """Rows of known customers; none if the column is absent."""
    if key_col not in rows.columns:
        return rows.where(F.lit(False))
    return rows.where(F.col(key_col).isin(*CUSTOMER_LABELS))
