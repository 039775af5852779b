import os
import sys

import pytest
from pyspark.sql import SparkSession, types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"

#: Documents as in the table, with columns that carry names the operators use inside.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("source", "row", "hash", "line", "start", "place", "record", "node", "ref_lang", "whole", "group")]
    + [T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        """Rows of (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", *"abcdefghij", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


def words(n, seed=0, prefix="w"):
    """``n`` distinct words."""
    return " ".join(f"{prefix}{seed}x{k}" for k in range(n))


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty and blank texts, a very long text, ties, repeated rows."""
    long_text = "\n".join(f"line {k} of a very long text with some words " + words(6, k) for k in range(4000))
    same = "one text that comes more than once and has enough words to count " + words(80, 7)
    return frame(
        [(1, None), (2, ""), (3, " \n\t "), (4, "?!"), (5, long_text), (6, same), (7, same), (7, same), (None, same), (None, None),
         (8, "short"), (9, same.upper(), None), (10, words(30, 3), None)]
    )


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
