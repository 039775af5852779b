"""Tables that are replaced as a whole: a folder per version, and a log that says which one counts.

A version becomes the table when its line is appended to the log, which Spark's committer does at once or not at all. Until then, and if
writing fails at any point, readers have the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_LOG = "versions"
_LOG_SCHEMA = "version long, name string, schema string"


@dataclass(frozen=True)
class Version:
    """``data`` holds the rows, ``files`` what is known of each file."""

    version: int
    data: str
    files: str
    schema: T.StructType


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LOG_SCHEMA).json(f"{path}/{_LOG}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current(spark: SparkSession, path: str) -> Version | None:
    """The version that counts, if any was ever committed. Of two committed at the same time, the later name."""
    log = _log(spark, path)
    last = log.orderBy(F.desc("version"), F.desc("name")).limit(1).collect() if log is not None else []
    if not last:
        return None
    row = last[0]
    return Version(row["version"], f"{path}/data-{row['name']}", f"{path}/files-{row['name']}", T.StructType.fromJson(json.loads(row["schema"])))


def replace(
    spark: SparkSession, path: str, schema: T.StructType, write: Callable[[str], None], describe: Callable[[str, str], None], keep: int = 2
) -> Version:
    """Makes a new version the table. ``write`` writes the rows to a folder, ``describe`` from it what is known of the files to
    another. The last ``keep`` versions stay, so that readers of the one before can end."""
    before = current(spark, path)
    name, version = uuid.uuid4().hex, before.version + 1 if before else 1
    write(f"{path}/data-{name}")
    describe(f"{path}/data-{name}", f"{path}/files-{name}")
    line = spark.createDataFrame([(version, name, schema.json())], _LOG_SCHEMA)
    line.coalesce(1).write.mode("append").json(f"{path}/{_LOG}")
    _drop_older(spark, path, version - keep)
    return current(spark, path)


def _drop_older(spark: SparkSession, path: str, upto: int) -> None:
    """Deletes the folders of versions up to this one; the log keeps their lines."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for row in _log(spark, path).where(F.col("version") <= upto).select("name").collect():
        for folder in (f"{path}/data-{row['name']}", f"{path}/files-{row['name']}"):
            target = hadoop.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
