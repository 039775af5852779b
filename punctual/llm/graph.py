"""Connected components in Spark by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.llm.common import stored_lean as stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``a`` is the larger end of every edge.

    Each node links its larger neighbours (large), or its smaller ones and itself (small), to the smallest of
    all neighbours. Minima are found by aggregation with a combine in the map tasks and joined back, so a node
    with many neighbours never gathers them in one place.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        linked = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = stored(edges.groupBy("a").agg(F.min("b").alias("low")))
        linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    return linked.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any orderable type to (node, component): the smallest node reachable, for all nodes with an edge.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        if not seen[0]:
            break
        now = stored(_stars(stored(_stars(now, large=True)), large=False))
    # Every node but a component's smallest now has the one edge to it.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
