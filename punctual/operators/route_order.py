"""Order of stops within a route.

A route is one tour on one day, its stops are one row per shop (and activity): orders are combined into stops
before anything is ordered. So a route has at most as many rows here as there are shops, however many orders it
has, also the one that holds all orders without a tour number. One window per route is therefore the whole plan,
the same for all routes and known without looking at the data; a window's rows spill to disk if they must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from punctual.sources.schema import ROUTE

_SHOP = "nm_short_unload"


def _order(ts: str, *ties: str) -> list[Column]:
    """By clock with missing ones last, then shop; a row without shop comes after all stops."""
    return [F.col(_SHOP).isNull(), F.col(ts).asc_nulls_last(), *[F.col(t) for t in (_SHOP, *ties)]]


def position(stops: DataFrame, ts: str, out: str) -> DataFrame:
    """Adds the 1-based place of each stop on its route by ``ts``."""
    return stops.withColumn(out, F.row_number().over(Window.partitionBy(*ROUTE).orderBy(*_order(ts))))


def previous(stops: DataFrame, ts: str, tie: str, values: dict[str, str]) -> DataFrame:
    """Adds values (new name -> column) of the stop before on the same route."""
    w = Window.partitionBy(*ROUTE).orderBy(*_order(ts, tie))
    return stops.withColumns({out: F.lag(c).over(w) for out, c in values.items()})
