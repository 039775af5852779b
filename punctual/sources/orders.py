"""The orders table: ingest, scan, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from punctual.functions.clocks import day_text, with_clock_text
from punctual.functions.text import id_text, number
from punctual.sources import versions
from punctual.sources.headers import file_headers
from punctual.sources.positions import with_position
from punctual.sources.schema import (
    CLOCK_COLUMNS, DURATION_COLUMNS, HEADER_ALIASES, ID_COLUMNS, ORDER_COLUMNS, ORDER_HEADERS, ORDERS_SCHEMA, TYPED_COLUMNS, TYPED_FIELDS,
    require, with_optional,
)


def read_raw(spark: SparkSession, path: str | list[str], fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """Order files as they are, every value as text, with each row's place as ``row_ord``.

    Files may have their columns in different orders: one job reads the first lines of all files, those with the same
    header are read together, and the results are put together by column name. ``multi_line`` lets quoted values hold
    line breaks; such a file cannot be split, so it is the caller's choice.
    """
    if fmt != "csv":
        return with_position(spark.read.format(fmt).load(path))
    headers = file_headers(spark, path)
    place = {name: k for k, name in enumerate(sorted(headers))}
    by_header: dict[tuple[str, ...], list[str]] = {}
    for name in place:
        by_header.setdefault(headers[name], []).append(name)
    parts = []
    for header, names in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in _distinct(header)])
        # Headers were compared, so the reader need not do it again.
        part = spark.read.schema(schema).options(header=True, multiLine=multi_line, enforceSchema=True).csv(names)
        parts.append(with_position(part, place=place))
    if not parts:
        return with_position(spark.read.options(header=True, multiLine=multi_line).csv(path))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    return together


def _distinct(names: tuple[str, ...]) -> list[str]:
    """Names that differ also when case does not count, as Spark wants them; one without a name takes its number."""
    names = tuple(name or f"_c{k}" for k, name in enumerate(names))
    seen: dict[str, int] = {}
    out = []
    for k, name in enumerate(names):
        first = seen.setdefault(name.lower(), k)
        out.append(name if first == k else f"{name}_{k + 1}")
    return out


def normalise_orders(raw: DataFrame) -> DataFrame:
    """Raw order rows, with their ``row_ord``, in the form of the orders table.

    Columns the file lacks are NULL. Columns the table does not know are kept behind its own, trimmed
    names and values as they are. If a file has both spellings of a column, each row takes the first that it
    has filled.
    """
    require(raw, ["row_ord"], "Place of each row missing")
    names = {**ORDER_HEADERS, **HEADER_ALIASES}
    found: dict[str, list[Column]] = {}
    extra: dict[str, Column] = {}
    for c in raw.columns:
        value, clean = F.col(f"`{c}`").cast("string"), c.strip()
        name = names.get(clean, clean)
        if name in ORDER_COLUMNS:
            found.setdefault(name, []).append(value)
        elif c != "row_ord":
            extra.setdefault(clean, value)
    picked = [F.coalesce(*[F.when(F.trim(v) != "", v) for v in found[n][:-1]], found[n][-1]).alias(n) for n in found]
    rows = with_optional(raw.select(*picked, *[v.alias(n) for n, v in extra.items()], "row_ord"), *ORDER_COLUMNS)
    rows = rows.withColumns({"date_dos": day_text("date_dos")} | {c: id_text(c) for c in ID_COLUMNS})
    rows = with_clock_text(rows, *CLOCK_COLUMNS)
    rows = rows.withColumn("cnr_tour", F.regexp_replace("cnr_tour", r"\.0$", ""))
    rows = rows.select(*ORDER_COLUMNS, *[f"`{n}`" for n in extra if n not in TYPED_COLUMNS], "row_ord")
    # Clocks are HH:MM by now. Reports read these numbers and need not look into texts.
    seconds = {f"{c}_sec": F.expr(f"cast(left({c}, 2) AS int) * 3600 + cast(right({c}, 2) AS int) * 60") for c in CLOCK_COLUMNS}
    return rows.withColumns(seconds | {f"{c}_num": number(c) for c in DURATION_COLUMNS})


def has_durations(raw: DataFrame) -> bool:
    """Whether the file has actual durations at all, as ``rca`` wants to know; looks at the header only."""
    names = {**ORDER_HEADERS, **HEADER_ALIASES}
    return any(names.get(c.strip(), c.strip()) == "duration_a" for c in raw.columns)


def write_orders(orders: DataFrame, path: str) -> None:
    """Replaces the whole table, one directory per day; until all is written, readers have the table as it was.

    The rebalance hint lets adaptive execution cut a large day into several files and put small days
    together, so one day with very many rows does not end up in one task. Rows are sorted by route
    inside each file, and each row group has a Bloom filter of its routes, so that looking for one skips the others.
    """
    spark = orders.sparkSession

    def write(folder: str) -> None:
        (
            orders.hint("rebalance", "date_dos")
            .sortWithinPartitions("date_dos", "cnr_tour", "row_ord")
            .write.partitionBy("date_dos")
            .options(**bloom_filters("cnr_tour"))
            .parquet(folder)
        )

    def describe(folder: str, files: str) -> None:
        """Places of the first and the last row of each activity in each file; reads two columns."""
        name = F.substring_index(F.col("_metadata.file_path"), folder.rstrip("/").split("/")[-1] + "/", -1)
        rows = spark.read.schema(orders.schema).parquet(folder).select(name.alias("file"), "date_dos", "rfx_activity", "row_ord")
        known = rows.groupBy("file", "date_dos", "rfx_activity").agg(F.count(F.lit(1)).alias("n"), F.min("row_ord").alias("first"), F.max("row_ord").alias("last"))
        known.write.parquet(files)

    versions.replace(spark, path, orders.schema, write, describe)


def bloom_filters(*names: str) -> dict[str, str]:
    """Options of the Parquet writer; each filter takes the size that its values need."""
    return {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{n}": "true" for n in names}


def ingest_orders(
    spark: SparkSession, source: str | list[str], path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Reads, normalises and stores order files; returns the stored table, further columns of the files included.

    A file without actual durations leaves none in the table either: its ``duration_a`` is NULL throughout, and
    ``has_durations`` on the raw file says so to ``rca``.
    """
    write_orders(normalise_orders(read_raw(spark, source, fmt, multi_line)), path)
    return read_orders(spark, path)


def read_orders(spark: SparkSession, path: str) -> DataFrame:
    """The stored table as it counts now, or an empty one if nothing was ingested yet."""
    version = versions.current(spark, path)
    if version is None:
        return spark.createDataFrame([], T.StructType([*ORDERS_SCHEMA.fields[:-1], *TYPED_FIELDS, ORDERS_SCHEMA.fields[-1]]))
    return spark.read.schema(version.schema).parquet(version.data).select(*[f"`{n}`" for n in version.schema.names])


def preview_stored(spark: SparkSession, path: str, limit: int = 500, **filters) -> DataFrame:
    """``orders_preview`` of the stored table from the files that can hold its rows.

    What was noted of each file when it was written says up to which place the wanted rows go, and which files begin
    before it. A filter by tour is left to the Bloom filters.
    """
    version = versions.current(spark, path)
    if version is None or filters.get("cnr_tour"):
        return orders_preview(read_orders(spark, path), limit, **filters)
    files = select_orders(spark.read.parquet(version.files), **filters)
    # One row per file and activity. Up to a file's last row, all rows of files that end before it are there.
    so_far = F.sum("n").over(Window.orderBy("last", "file", "rfx_activity").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    enough = files.withColumn("so_far", so_far).where(F.col("so_far") >= limit).agg(F.min("last")).first()[0]
    if enough is not None:
        files = files.where(F.col("first") <= enough)
    names = sorted(r["file"] for r in files.select("file").distinct().collect())
    rows = spark.read.schema(version.schema)
    rows = rows.option("basePath", version.data).parquet(*[f"{version.data}/{n}" for n in names]) if names else spark.createDataFrame([], version.schema)
    rows = rows.select(*[f"`{n}`" for n in version.schema.names])
    return orders_preview(rows if enough is None else rows.where(F.col("row_ord") <= enough), limit, **filters)


def select_orders(
    orders: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    rfx_activity: str | None = None,
    cnr_tour: str | None = None,
) -> DataFrame:
    """Filtered scan. Days are compared as ISO text, both ends inclusive; no filter keeps all rows.

    On the stored table the day filter prunes directories and the others reach the Parquet reader.
    """
    if date_from:
        orders = orders.where(F.col("date_dos") >= date_from)
    if date_to:
        orders = orders.where(F.col("date_dos") <= date_to)
    if rfx_activity:
        orders = orders.where(F.col("rfx_activity") == rfx_activity)
    if cnr_tour:
        orders = orders.where(F.col("cnr_tour") == str(cnr_tour))
    return orders


def scan_orders(orders: DataFrame, **filters) -> DataFrame:
    """``select_orders`` without what ingest has read out of the texts."""
    return select_orders(orders, **filters).drop(*TYPED_COLUMNS)


def orders_preview(orders: DataFrame, limit: int = 500, **filters) -> DataFrame:
    """First rows in file order."""
    return scan_orders(orders, **filters).orderBy("row_ord").limit(limit)


def route_options(orders: DataFrame, **filters) -> DataFrame:
    """Route numbers to choose from, in order."""
    routes = select_orders(orders, **filters).select("cnr_tour")
    return routes.where(F.col("cnr_tour").isNotNull()).distinct().orderBy("cnr_tour")
