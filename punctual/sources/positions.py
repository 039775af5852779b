"""The place of each row in the files it was read from.

"First" means first in the file, so the place must not depend on how Spark packs files into tasks: files
count by path, rows by where they stand in their file. Both fit into one LONG.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

# Bits for the place inside a file: a terabyte of text, or as many rows.
_PLACE_BITS = 40

#: Rows of a broadcast table with a path and a few numbers: below 100 MB.
MOST_BROADCAST = 500_000


def _spellings(path: str) -> list[str]:
    """A local path as Spark shows it, with one or three slashes; so it need not be rewritten in each row."""
    name = path.removeprefix("file:").lstrip("/")
    return [f"file:/{name}", f"file:///{name}"] if path.startswith("file:") else [path]


def with_position(files: DataFrame, name: str = "row_ord", place: dict[str, int] | None = None) -> DataFrame:
    """``files``, as the reader gives it, with the place of each row. ``place``: numbers of the files, by path if not given.

    Parquet knows the row's index, and filters still reach the scan. In text files the rows of each block are counted
    first (no column is read), and a row's place is the sum of the counts of the blocks before in its file plus its number in
    the block; so it does not depend on the size of blocks. Raw rows are not shuffled: counts are, one per block, and
    they are broadcast up to ``MOST_BROADCAST`` of them; more are joined as Spark decides by their size.
    """
    number = place or {path: k for k, path in enumerate(sorted(files.inputFiles()))}
    columns = [F.col(f"`{c}`") for c in files.columns]
    # A row per file and spelling of its path.
    numbers = files.sparkSession.createDataFrame([(k, p) for path, k in number.items() for p in _spellings(path)], "__file long, __path string")
    numbers = numbers.select((F.shiftleft("__file", _PLACE_BITS)).alias("__start"), "__path")
    if _has_row_index(files):
        placed = files.select(*columns, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__place"))
        if len(number) < 2:
            return placed.select(*columns, F.col("__place").alias(name))
        joined = placed.join(_small(numbers, 2 * len(number)), "__path")
        return joined.select(*columns, (F.col("__start") + F.col("__place")).alias(name))
    placed = files.select(
        *columns, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__read"),
    )
    # A block's rows are read by one task, one after the other.
    counts = placed.groupBy("__path", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__read").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.join(numbers, "__path").select("__path", "__block", (F.col("__start") + before - F.col("__first")).alias("__start"))
    # At most one block per file and per task of the scan.
    joined = placed.join(_small(starts, len(number) + files.rdd.getNumPartitions()), ["__path", "__block"])
    return joined.select(*columns, (F.col("__start") + F.col("__read")).alias(name))


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def _has_row_index(files: DataFrame) -> bool:
    """Whether the format numbers its rows, as Parquet does."""
    try:
        files.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True
