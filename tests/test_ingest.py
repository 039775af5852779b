"""Order files as they come: several files, quoted line breaks, further columns, places of rows."""

import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from punctual import fixture
from punctual.plans import jit, window_report
from punctual.sources import orders as ot
from punctual.sources.positions import with_position

HEAD = "date_dos,cnr_tour,cnr_cust,RFX Activity,nm_short_unload,Planned"


@pytest.fixture
def ingest(spark, tmp_path):
    def run(*files, **options):
        source = tmp_path / "in"
        source.mkdir()
        for k, text in enumerate(files):
            (source / f"{k + 1}.csv").write_text(text)
        return ot.ingest_orders(spark, str(source), str(tmp_path / "table"), **options).orderBy("row_ord")

    return run


def test_files_with_columns_in_another_order(ingest):
    rows = ingest(
        f"{HEAD}\n2024-03-05,7,Z1,4,A,08:00\n", "cnr_cust,date_dos,nm_short_unload,cnr_tour,RFX Activity\nZ2,2024-03-06,B,8,5\n"
    ).collect()
    assert [(r.date_dos, r.cnr_tour, r.cnr_cust, r.rfx_activity, r.nm_short_unload, r.planned) for r in rows] == [
        ("2024-03-05", "7", "Z1", "4", "A", "08:00"), ("2024-03-06", "8", "Z2", "5", "B", None)
    ]


def test_quoted_line_breaks(ingest):
    (row,) = ingest(f'{HEAD}\n2024-03-05,7,Z1,4,"Shop\nA",08:00\n', multi_line=True).collect()
    assert row.nm_short_unload == "Shop\nA" and row.date_dos == "2024-03-05" and row.planned == "08:00"


def test_identifiers_are_trimmed_so_reports_compare_plainly(ingest):
    table = ingest(f"{HEAD},Win FROM,Win UNTIL,Actual\n2024-03-05, 7 ,Z1, 5 ,A,08:00,08:00,09:00,08:30\n")
    assert [(r.cnr_tour, r.rfx_activity) for r in table.collect()] == [("7", "5")]
    assert window_report.window_summary(table).first().totaal_orders == 1


def test_further_columns_are_kept(ingest):
    (row,) = ingest(f"{HEAD}, Driver Name \n2024-03-05,7,Z1,4,A,08:00, Jo \n").collect()
    assert row["Driver Name"] == " Jo "


def test_both_spellings_of_a_column(spark, ingest):
    rows = ingest(f"{HEAD},DurationA,duration_A\n2024-03-05,7,Z1,4,A,08:00,,12\n2024-03-05,7,Z1,4,B,08:00,5,12\n").collect()
    assert [r.duration_a for r in rows] == ["12", "5"]


def test_whether_a_file_has_durations(spark):
    assert ot.has_durations(spark.createDataFrame([], " `duration_A ` string"))
    assert not ot.has_durations(spark.createDataFrame([], "duration_p string"))


@pytest.mark.parametrize("block", ["64", "1000", "1m"])
def test_places_do_not_depend_on_blocks(spark, tmp_path, block):
    source = tmp_path / "in"
    source.mkdir()
    n = 0
    for name, lines in (("b", 40), ("a", 3), ("c", 90)):
        (source / f"{name}.csv").write_text("x\n" + "".join(f"{name}{k:03}\n" for k in range(lines)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = with_position(spark.read.option("header", True).csv(str(source))).orderBy("row_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.x for r in rows] == [f"{name}{k:03}" for name, lines in (("a", 3), ("b", 40), ("c", 90)) for k in range(lines)]


def test_places_of_several_parquet_files(spark, tmp_path):
    frame = spark.range(0, 1000, 1, 7)
    frame.write.parquet(str(tmp_path / "p"))
    rows = with_position(spark.read.parquet(str(tmp_path / "p"))).orderBy("row_ord").collect()
    assert [r.id for r in rows] == list(range(1000))


def test_filters_reach_the_scan_of_the_derived_orders(spark):
    df = jit.stop_deliveries(fixture.otif_orders(spark, f"{TESTDATA}/sf0.001"), date_from="1995-01-01", cnr_tour="770001")
    scan = df._jdf.queryExecution().executedPlan().toString().split("FileScan")[1]
    assert "DataFilters: []" not in scan and "l_shipdate" in scan.split("DataFilters")[1]


def test_window_filters_reach_the_stored_table(spark, ingest):
    table = ingest(f"{HEAD},Win FROM,Win UNTIL,Actual\n2024-03-05,7,Z1,4,A,08:00,08:00,09:00,08:30\n")
    df = window_report.window_route_detail_deliveries(table, "2024-03-05", "7")
    scan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert "In(rfx_activity" in scan and "EqualTo(cnr_tour,7)" in scan


def test_reports_without_any_delivery_are_empty(spark, ingest):
    table = ingest(f"{HEAD},Actual\n2024-03-05,7,Z1,4,A,08:00,08:30\n")
    for name, report in window_report.window_report(table).items():
        assert report.count() == 0, name


def test_window_orders_name_what_is_missing(spark, ingest):
    with pytest.raises(ValueError, match="row_ord"):
        window_report.window_orders(ingest(f"{HEAD}\n").drop("row_ord"))


def jobs(spark, group, build):
    """How many jobs ``build`` starts, and what it returns."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = build()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    found = []
    # Spark lists more than 32 paths by a job of its own.
    for n in (70, 140):
        source = tmp_path / str(n)
        source.mkdir()
        for k in range(n):
            head = HEAD if k % 2 else "cnr_cust,date_dos"
            (source / f"{k:03}.csv").write_text(f"{head}\n" + ("2024-03-05,7,Z1,4,A,08:00\n" if k % 2 else f"Z{k},2024-03-06\n"))
        count, raw = jobs(spark, f"read-{n}", lambda source=source: ot.read_raw(spark, str(source)))
        found.append(count)
        rows = raw.orderBy("row_ord").collect()
        assert [r.cnr_cust for r in rows] == [f"Z{1 if k % 2 else k}" for k in range(n)]
    assert found[0] == found[1]


def test_raw_rows_are_not_shuffled(spark, tmp_path):
    """The only exchanges carry counts of blocks."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"{HEAD}\n2024-03-05,7,Z1,4,A,08:00\n")
    plan = ot.normalise_orders(ot.read_raw(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    for part in plan.split("Exchange hashpartitioning(")[1:]:
        assert "nm_short_unload" not in part.split("FileScan")[0]


@pytest.mark.parametrize("block", ["64", "1000", "1m"])
def test_places_count_the_rows(spark, tmp_path, block):
    """The place is the file's number and the row's, for any size of blocks."""
    for name, lines in (("b", 40), ("a", 3), ("c", 90)):
        (tmp_path / f"{name}.csv").write_text("x\n" + "".join(f"{name}{k:03}\n" + "\n" * (k % 7 == 0) for k in range(lines)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        rows = with_position(spark.read.option("header", True).csv(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.x: r.row_ord for r in rows} == {
        f"{name}{k:03}": (file << 40) + k for file, (name, lines) in enumerate((("a", 3), ("b", 40), ("c", 90))) for k in range(lines)
    }


def test_headers_of_odd_files(spark, tmp_path):
    from punctual.sources.headers import file_headers

    texts = {
        "plain": "a,b\n1,2\n", "quoted": '"a ""x"", y",b\n', "broken": '"two\nlines",b\n1,2\n', "blank": "\n  \na,b\n", "empty": "",
        "unnamed": "a,,b\n", "mark": "﻿a,b\n", "long": "a,b\n" + "1,2\n" * 200_000,
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    found = {path.split("/")[-1].removesuffix(".csv"): header for path, header in file_headers(spark, str(tmp_path)).items()}
    assert found == {
        "plain": ("a", "b"), "quoted": ('a "x", y', "b"), "broken": ("two\nlines", "b"), "blank": ("a", "b"), "unnamed": ("a", "", "b"),
        "mark": ("a", "b"), "long": ("a", "b"),
    }


def test_paths_are_not_rewritten_in_each_row(spark, tmp_path, capsys):
    """Files are told by their path as Spark shows it, in a local folder too."""
    for k in range(2):
        spark.range(3 * k, 3 * k + 3).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    placed = with_position(spark.read.parquet(f"{tmp_path}/0", f"{tmp_path}/1"))
    placed.explain()
    assert "regexp_replace" not in capsys.readouterr().out
    assert [r["id"] for r in placed.orderBy("row_ord").collect()] == list(range(6))
