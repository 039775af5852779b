"""Helpers shared by the operators: table access, tables kept in the cluster's shared folder, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space as the digest contracts know it; a word is a run of anything else.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers import this package from where the driver found it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where the session names none and runs on this machine alone (tests), a local one is made."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _local_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


@cache
def _local_dir(application: str) -> str:
    """One per session."""
    return tempfile.mkdtemp(prefix="punctual-")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


#: Spark deletes shuffle files when their plan is collected as garbage, which may be much later; with this, at the end of a write.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: What goes to a Python worker at once; it is held several times, by the JVM and the worker.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def stored_lean(df: DataFrame) -> DataFrame:
    """``stored`` by small batches, and the shuffle files that made it go at once. ``df`` itself should not be evaluated again."""
    spark = df.sparkSession
    before = {name: spark.conf.get(name) for name in (_CLEAN_UP, _BATCH)}
    spark.conf.set(_CLEAN_UP, "true")
    spark.conf.set(_BATCH, _BATCH_BYTES)
    try:
        return stored(df)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def forget(table_: DataFrame) -> None:
    """Deletes a stored table that nothing will read any more."""
    context = table_.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(table_.inputFiles()[0].rsplit("/", 1)[0])
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    An expression used inside a lambda is evaluated again for every element; a lambda's own variable is not.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
