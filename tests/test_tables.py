"""The stored tables: replaced at once or not at all, filters that skip row groups, previews and appends that leave the table alone."""

import os

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from punctual.sources import deliveries as dt, orders as ot, versions
from punctual.sources.schema import DELIVERY_COLUMNS, ORDER_COLUMNS


def many(spark, days=30, rows=40):
    """Orders of several days in the order of the days, tours and activities mixed."""
    df = spark.range(days * rows).select(
        F.expr(f"date_format(date_add('2024-03-01', cast(id DIV {rows} AS int)), 'yyyy-MM-dd')").alias("date_dos"),
        (F.col("id") * 7 % 11).cast("string").alias("cnr_tour"), (F.col("id") % 3).cast("string").alias("RFX Activity"),
        F.lit("08:30").alias("Planned"), F.lit("A").alias("nm_short_unload"), F.col("id").alias("row_ord"),
    )
    return ot.normalise_orders(df)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders") / "table")
    ot.write_orders(many(spark), path)
    return path


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = many(spark, 2, 5)
    ot.write_orders(rows, path)
    before = ot.read_orders(spark, path)
    broken = rows.withColumn("cnr_cust", F.when(F.col("row_ord") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("cnr_cust")))
    with pytest.raises(Exception, match="lost"):
        ot.write_orders(broken, path)
    assert spark_rows(ot.read_orders(spark, path)) == spark_rows(rows)
    ot.write_orders(rows.where("row_ord < 3"), path)
    # A reader that began before the last version can still end.
    assert before.count() == 10 and ot.read_orders(spark, path).count() == 3
    ot.write_orders(rows.where("row_ord < 2"), path)
    assert ot.read_orders(spark, path).count() == 2 and versions.current(spark, path).version == 3
    kept = [n for n in os.listdir(path) if n.startswith("data-")]
    # Two versions, and what the failed write may have left.
    assert 2 <= len(kept) <= 3


def test_further_columns_are_part_of_the_version(spark, tmp_path):
    path = str(tmp_path / "table")
    ot.write_orders(many(spark, 1, 3).withColumn("Driver", F.lit("Jo")), path)
    assert {r.Driver for r in ot.read_orders(spark, path).collect()} == {"Jo"}
    assert ot.read_orders(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(
    "limit, filters", [(50, {}), (1, {}), (0, {}), (5000, {}), (50, {"rfx_activity": "1"}), (30, {"date_from": "2024-03-05", "date_to": "2024-03-09"}), (9, {"cnr_tour": "7"}), (5, {"rfx_activity": "9"})]
)
def test_preview_of_the_stored_table(spark, table, limit, filters):
    got = ot.preview_stored(spark, table, limit, **filters)
    want = ot.orders_preview(many(spark), limit, **filters)
    assert [tuple(r) for r in got.select(*ORDER_COLUMNS).collect()] == [tuple(r) for r in want.select(*ORDER_COLUMNS).collect()]
    if limit == 50:
        # 30 days are 30 files; the first ones are enough.
        assert len(ot.read_orders(spark, table).inputFiles()) == 30 and len(got.inputFiles()) <= 4


def scanned(df):
    """Rows that the scan of a plan of narrow steps gave out."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("name", ["uid", "cnr_tour"])
def test_bloom_filters_skip_row_groups(spark, tmp_path, name):
    """Looked-for values lie inside the range of every row group, so only the Bloom filter can tell."""
    path = str(tmp_path / "deliveries")
    batch = spark.range(4000).select(
        F.concat(F.lit("u"), F.col("id") * 2).alias("uid"), F.concat(F.lit("t"), F.col("id") * 2).alias("cnr_tour"), F.lit("2024-03-05").alias("date_dos"), F.col("id").alias("row_ord")
    )
    dt.append_deliveries(spark, path, batch)
    options = {"parquet.filter.dictionary.enabled": "false", "parquet.filter.columnindex.enabled": "false"}
    prefix = {"uid": "u", "cnr_tour": "t"}[name]
    for use, missing in ((True, 0), (False, 4000)):
        rows = spark.read.options(**options, **{"parquet.filter.bloom.enabled": str(use).lower()}).parquet(path)
        assert scanned(rows.where(F.col(name) == f"{prefix}4001").select("customer")) == missing
        assert rows.where(F.col(name) == f"{prefix}4000").count() == 1


def delivery_rows(spark, ids):
    return spark.createDataFrame([(i, "2024-03-05", k) for k, i in enumerate(ids)], "uid string, date_dos string, row_ord long")


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_append_does_not_shuffle_the_target(spark, tmp_path, monkeypatch, most):
    """Both ways give the same rows; up to the bound the target is only read."""
    monkeypatch.setattr(dt, "MOST_IDS", most)
    path = str(tmp_path / "deliveries")
    dt.append_deliveries(spark, path, delivery_rows(spark, ["a", "b", "a", None]))
    fresh = dt.new_deliveries(dt.read_deliveries(spark, path), delivery_rows(spark, ["b", "c", None, "c", None]))
    assert sorted(str(r.uid) for r in fresh.collect()) == ["None", "None", "c"]
    assert fresh.columns == DELIVERY_COLUMNS
    plan = fresh._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # From the scan of the target upwards: a look-up before any exchange.
    above = plan[: plan.index("FileScan")].split("\n")
    shuffled = next(line for line in reversed(above) if "Exchange" in line or "BroadcastHashJoin" in line)
    assert ("BroadcastHashJoin" in shuffled) == (most > 0)
