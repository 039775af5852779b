"""Arrays of numbers in Arrow batches as dense matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


def dimension(df: DataFrame, vector: Column) -> int:
    """The most frequent length of the vectors, of equal ones the longest; 0 if there are none.

    Distinct lengths are counted in the map tasks and only the winner reaches the driver.
    """
    lengths = df.select(F.size(vector).alias("d")).where("d > 0").groupBy("d").count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return first[0]["d"] if first else 0


def dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows (doubles) of the vectors of length ``dim`` whose entries are all there and finite."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    places = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    # Missing entries become NaN.
    values = column.take(pa.array(places)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(values).all(axis=1)
    return places[finite], values[finite]
