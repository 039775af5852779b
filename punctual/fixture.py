"""Order, raw-file and delivery tables derived from ``lineitem``.

The given tables hold no delivery windows, so every registered query runs on these projections: one
order per line item, with windows, clocks, gaps and bad values made from its columns. They are plain
expressions over one scan, so filters, column pruning and parallelism are those of the scan.
``row_ord`` is the position in the stored table. As in a table that ingest has written, clocks stand there as texts and
as seconds of the day, durations as texts and as numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.functions.clocks import minute_clock
from punctual.sources.positions import with_position


_ORDERS = {
    "date_dos": "cast(d AS string)",
    "cnr_tour": "cast(770000 + sk % 4 AS string)",
    "cnr_cust": "element_at(array('Z41102', 'Z41103', 'Z41104', 'Z41105', 'Z41108', 'Z49999'), cast(ok % 6 + 1 AS int))",
    "rfx_activity": "cast(3 + ok % 4 AS string)",
    "rfx_year": "cast(ok % 100 AS string)",
    "rfx_preparation": "cast(pk % 100 AS string)",
    "nm_short_unload": "if(ok % 61 = 0, NULL, concat('ST', cast(pk % 8 AS string)))",
    "win_from": minute_clock("opens_min"),
    "win_until": f"if(ok % 53 = 0, NULL, {minute_clock('closes_min')})",
    "planned": f"if(ok % 59 = 0, NULL, {minute_clock('due_min')})",
    "p_depart": "if(ok % 47 = 0, NULL, '05:30')",
    "duration_p": "cast(10 + pk % 25 AS string)",
    "actual": f"CASE WHEN ok % 41 = 0 THEN NULL WHEN ok % 43 = 0 THEN 'n/a' WHEN ok % 67 = 0 THEN ''"
    f" ELSE {minute_clock('arrives_min')} END",
    "a_depart": f"if(ok % 37 = 0, NULL, {minute_clock('leaves_min')})",
    "duration_a": "CASE WHEN ok % 31 = 0 THEN NULL WHEN ok % 29 = 0 THEN 'x' ELSE cast(5 + q AS string) END",
    "site": "concat('SITE', cast(sk % 5 AS string))",
    "reason": "element_at(array('late_dispatch', 'early_dispatch', 'last_minute_change', 'wms_tms_mismatch',"
    " 'insufficient_stock', 'picking_delay', 'other_code', '', NULL), cast(ok % 9 + 1 AS int))",
    "win_from_sec": "opens_min * 60",
    "win_until_sec": "if(ok % 53 = 0, NULL, closes_min * 60)",
    "planned_sec": "if(ok % 59 = 0, NULL, due_min * 60)",
    "actual_sec": "if(ok % 41 = 0 OR ok % 43 = 0 OR ok % 67 = 0, NULL, arrives_min * 60)",
    "p_depart_sec": "if(ok % 47 = 0, NULL, 19800)",
    "a_depart_sec": "if(ok % 37 = 0, NULL, leaves_min * 60)",
    "duration_p_num": "cast(10 + pk % 25 AS double)",
    "duration_a_num": "if(ok % 31 = 0 OR ok % 29 = 0, NULL, cast(5 + q AS double))",
    "uid": "concat_ws('-', ok, ln)",
    "row_ord": "row_ord",
}


def otif_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table, plus ``site``, ``reason`` and the line key for the delivery table.

    Minutes and texts are made one after the other, so that no generated method grows too large to be compiled.
    A clock is looked up by its minute.
    """
    line = with_position(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).selectExpr(
        "cast(l_orderkey AS bigint) ok", "cast(l_partkey AS bigint) pk", "cast(l_suppkey AS bigint) sk",
        "cast(l_quantity AS int) q", "l_linenumber ln", "cast(l_shipdate AS date) d",
        "row_ord",
    )
    minutes = {
        "opens": "base + sk % 3 * 5", "closes": "base + sk % 3 * 5 + 60", "due": "base + 20 + ok % 4 * 5",
        "arrives": "base - 25 + q * 3 + ok % 7", "leaves": "base - 15 + q * 4 + ok % 7",
    }
    line = line.selectExpr("*", "360 + pk % 8 * 75 AS base")
    line = line.selectExpr("*", *[f"cast({sql} AS int) AS {name}_min" for name, sql in minutes.items()])
    return line.selectExpr(*[f"{sql} AS {name}" for name, sql in _ORDERS.items()])


def wide_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders over 40 shops and 100 tours, with missing days, tours, shops and activities."""
    year, part = F.col("rfx_year").cast("int"), F.col("rfx_preparation").cast("int")
    return otif_orders(spark, sf_dir).withColumns(
        {
            "date_dos": F.when(year % 19 != 0, F.col("date_dos")),
            "cnr_tour": F.when(year % 13 != 0, F.concat_ws("-", "cnr_tour", (part % 25).cast("string"))),
            "nm_short_unload": F.when(year % 17 != 0, F.concat(F.lit("W"), (part % 40).cast("string"))),
            "rfx_activity": F.when(year % 23 != 0, F.col("rfx_activity")),
        }
    )


def raw_order_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders as a raw file has them: other headers, blanks and several date and time forms."""
    o = otif_orders(spark, sf_dir)
    day = F.to_date("date_dos")
    form = F.col("rfx_activity")
    return o.select(
        F.when(form == "3", F.date_format(day, "MM/dd/yyyy"))
        .when(form == "4", F.concat("date_dos", F.lit(" 00:00:00")))
        .when((form == "5") & (F.col("rfx_year") < "5"), F.date_format(day, "d MMM yyyy"))
        .when((form == "5") & (F.col("rfx_year") < "9"), F.date_format(day, "MM.dd.yyyy"))
        .when(form == "5", F.date_format(day, "yyyy/MM/dd"))
        .otherwise(F.col("date_dos")).alias(" date_dos "),
        F.concat("cnr_tour", F.lit(".0")).alias("cnr_tour"),
        F.when(F.col("cnr_cust") != "Z49999", F.concat(F.lit(" "), "cnr_cust", F.lit("  "))).alias("cnr_cust"),
        F.concat(F.lit(" "), "rfx_activity").alias("RFX Activity "),
        F.col("rfx_year").alias("RFX Year"),
        F.col("rfx_preparation").alias("RFX Preperation"),
        "nm_short_unload",
        F.concat("win_from", F.lit(":00")).alias("Win FROM"),
        F.regexp_replace("win_until", "^0", "").alias("Win UNTIL"),
        F.concat(F.lit("1900-01-01 "), "planned", F.lit(":00")).alias("Planned"),
        F.when(form == "3", F.concat(F.lit("01/02/2024 "), "p_depart")).otherwise(F.concat(F.substring("p_depart", 2, 4), F.lit(" AM"))).alias("P_Depart"),
        F.col("duration_p").alias("DurationP"),
        F.col("actual").alias("Actual"),
        F.concat(F.lit(" "), "a_depart").alias("A_Depart"),
        F.col("duration_a").alias("duration_A"),
        "row_ord",
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries with planned and actual time; ``uid`` repeats, as in a file loaded twice."""
    o = otif_orders(spark, sf_dir)
    return o.select(
        "uid", "cnr_tour", "cnr_cust", "nm_short_unload", F.col("cnr_cust").alias("customer"), "site",
        F.concat("date_dos", F.lit(" "), "planned").alias("planned_time"),
        F.concat("date_dos", F.lit(" "), "actual").alias("actual_time"),
        "date_dos", F.col("planned").alias("raw_planned"), F.col("actual").alias("raw_actual"),
        "reason", "row_ord",
    )
