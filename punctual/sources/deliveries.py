"""The deliveries table: idempotent append and range scan."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.sources.orders import bloom_filters
from punctual.sources.schema import DELIVERIES_SCHEMA, DELIVERY_COLUMNS, require, with_optional

_NOT_INSERTED = {"created_at", "updated_at"}

#: Ids of a batch that may be broadcast, some 100 MB of them.
MOST_IDS = 1_000_000


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """The stored table, or an empty one if nothing was appended yet."""
    try:
        stored = spark.read.schema(DELIVERIES_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DELIVERIES_SCHEMA)
    return stored.select(*DELIVERY_COLUMNS)


def new_deliveries(target: DataFrame, batch: DataFrame, created_at: str | None = None) -> DataFrame:
    """Rows of ``batch`` whose ``uid`` is not in ``target`` yet; of equal ones the first by ``row_ord``.

    Rows without ``uid`` never conflict and are all kept. They get their own position as second key for
    grouping, so many of them spread over all tasks. The first row per uid is an aggregate, so copies are dropped
    before the shuffle. The ids of the batch are counted first: up to ``MOST_IDS`` they are broadcast and the
    target is read but not shuffled; beyond, both sides are joined by a shuffle of their ids.
    """
    require(batch, ["row_ord"], "Which of equal deliveries comes first is not known without")
    stamp = F.lit(created_at) if created_at else F.date_format(
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp()), "yyyy-MM-dd HH:mm:ss"
    )
    values = [c for c in DELIVERY_COLUMNS if c not in _NOT_INSERTED and c != "uid"]
    first = (
        with_optional(batch, *DELIVERY_COLUMNS)
        .groupBy("uid", F.when(F.col("uid").isNull(), F.col("row_ord")).alias("_own"))
        .agg(F.min_by(F.struct(*values), "row_ord").alias("_row"))
    )
    ids = batch.select("uid").where(F.col("uid").isNotNull()).distinct()
    known = target.select("uid")
    if ids.count() <= MOST_IDS:
        # The target stays where it is: its ids are looked up in those of the batch, and what is found, at most one
        # row per id of the batch, in turn.
        known = F.broadcast(known.join(F.broadcast(ids), "uid", "left_semi"))
    fresh = first.join(known, "uid", "left_anti")
    return fresh.select(
        "uid", "_row.*", stamp.alias("created_at"), F.lit(None).cast("string").alias("updated_at")
    ).select(*DELIVERY_COLUMNS)


def append_deliveries(
    spark: SparkSession, path: str, batch: DataFrame, created_at: str | None = None
) -> DataFrame:
    """Stores the new rows of ``batch`` and returns the table; a second run adds nothing."""
    fresh = new_deliveries(read_deliveries(spark, path), batch, created_at)
    (
        fresh.hint("rebalance", "date_dos")
        .sortWithinPartitions("date_dos", "cnr_tour")
        .write.mode("append")
        .options(**bloom_filters("uid", "cnr_tour"))
        .partitionBy("date_dos")
        .parquet(path)
    )
    return read_deliveries(spark, path)


def scan_deliveries(
    deliveries: DataFrame, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Range scan that includes the first day and excludes the last."""
    if date_from:
        deliveries = deliveries.where(F.col("date_dos") >= date_from)
    if date_to:
        deliveries = deliveries.where(F.col("date_dos") < date_to)
    return deliveries
