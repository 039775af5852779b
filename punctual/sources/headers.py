"""The headers of many text files, read by one job."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A header with line breaks inside quotes ends within so many lines.
MOST_LINES = 100
#: Batches of Arrow that a piece of a file may have to be read to its end.
READ_ON = 2


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to the line that ends the header, from the partition's one piece of a file.

    Reading stops soon after. A short piece is read to its end, as that lets Spark use the Python worker again.
    """
    lines, quotes, done = [], 0, False
    for k, batch in enumerate(batches):
        done = done or batch.num_rows > 0 and batch.column(2)[0].as_py() > 0
        for path, value in zip(batch.column(0), batch.column(1)) if not done else ():
            line = value.as_py()
            if lines or line.strip():
                lines.append(line)
                quotes += line.count('"')
                if quotes % 2 == 0 or len(lines) == MOST_LINES:
                    yield pa.RecordBatch.from_pydict({"path": pa.array([path.as_py()]), "header": pa.array(["\n".join(lines)])})
                    done = True
                    break
        if done and k >= READ_ON:
            return


def first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path`` and ``header`` text of each file that has one.

    Every piece of a file is a partition of its own here, so that a task ends with its first line, and a piece
    other than a file's first one yields nothing.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("block"))
    return lines.mapInArrow(_first_lines, "path string, header string")


def file_headers(spark: SparkSession, path: str | list[str]) -> dict[str, tuple[str, ...]]:
    """Header of each file by path; files without any line are left out. One job, one small row per file."""
    packing = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(packing)
    # No two pieces in one partition.
    spark.conf.set(packing, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        rows = first_lines(spark, path).collect()
    finally:
        spark.conf.set(packing, before)
    return {r["path"]: tuple(next(csv.reader(r["header"].splitlines(keepends=True)))) for r in rows}
