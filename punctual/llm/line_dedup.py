r"""Removal of repeated runs of lines by a suffix array over line ids.

Lines become 128-bit ids, a document a sequence of them. Prefix doubling ranks the suffixes by their first 1,
2, 4, ... lines: the rank at depth 2d orders the pairs (rank at d here, rank at d, d lines on). Numbers come
from range partitioning and sorting of the distinct pairs, so they keep the lexicographic order without
passing through one task. Suffixes of one rank are an LCP interval: they share that many lines. An interval
of one suffix cannot repeat at any greater depth and is dropped, so every step works on repeated lines only.

An interval of any depth d between two powers is named by the two overlapping ranks that span d lines. A run
counts from ``LEAST_WORDS`` words. Each line is tested in the shortest such run that starts with it and in the
shortest that ends with it; together these cover exactly the lines of all maximal repeated runs of that many
words. In an interval the first run by (doc_id, text hash, line) stays; lines of the others are deleted.

Lines are parts between ``\n``. Null text has no lines and stays null; empty lines take part in runs; rows
that are equal in id and text are one document, each written out; null ids come first in the order; an empty
table gives an empty result; further columns stay (the names in ``ADDED`` are replaced). A document may lose
all lines: its text is then empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from punctual.llm.common import BLANKS, let, stored

LEAST_WORDS = 10
ADDED = ["n_lines", "n_removed_lines", "removed_lines"]
_AT = ["doc", "hash", "line"]


def _identity(doc_id: Column, text: Column) -> dict[str, Column]:
    """What tells documents apart and orders them."""
    return {"doc": F.coalesce(doc_id.cast("long"), F.lit(-(2**63))), "hash": F.xxhash64(text)}


def line_ids(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each line's place, 128-bit id and number of words, once for rows equal in id and text."""
    whole = F.col(f"`{text}`")
    placed = docs.where(whole.isNotNull()).select(
        *[value.alias(name) for name, value in _identity(F.col(f"`{doc_id}`"), whole).items()],
        F.posexplode(F.split(whole, "\n")).alias("line", "content"),
    )
    words = F.size(F.filter(F.split("content", BLANKS), lambda w: w != ""))
    return placed.select(*_AT, F.xxhash64("content").alias("x"), F.xxhash64(F.lit(1), "content").alias("y"), words.alias("words")).distinct()


def shortest_runs(lines: DataFrame, least: int) -> DataFrame:
    """(doc, hash, line, len): for each line the shortest run of ``least`` words from it, and the shortest up to it.

    With c(k) the words before line k, a run from i ends at the smallest k with c(k) >= c(i) + least. Asking
    and answering rows are sorted together, so a running "last seen" finds k.
    """
    doc = Window.partitionBy("doc", "hash")
    before = F.coalesce(F.sum("words").over(doc.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = lines.select(*_AT, before.alias("c"), "words")
    # Every line start is a boundary, and so is the end of the last line.
    last = F.row_number().over(doc.orderBy(F.desc("line"))) == 1
    marks = ends.withColumn("last", last).select(
        "doc", "hash", F.explode(F.array(F.struct(F.col("line").alias("k"), "c"), F.when(F.col("last"), F.struct((F.col("line") + 1).alias("k"), (F.col("c") + F.col("words")).alias("c"))))).alias("m")
    ).where("m is not null").select("doc", "hash", "m.k", "m.c")
    roles = F.array(
        F.struct(F.lit(0).alias("ask"), F.col("c").alias("v")),
        F.struct(F.lit(1).alias("ask"), (F.col("c") + least).alias("v")),
        F.struct(F.lit(-1).alias("ask"), (F.col("c") - least).alias("v")),
    )
    both = marks.select("doc", "hash", "k", F.inline(roles))
    answer = F.when(F.col("ask") == 0, F.col("k"))
    running = lambda *order: doc.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns(
        {
            # Boundaries stand before questions of the same value; of equal boundaries the nearest comes last.
            "end": F.last(answer, ignorenulls=True).over(running(F.desc("v"), F.expr("ask != 0"), F.desc("k"))),
            "start": F.last(answer, ignorenulls=True).over(running(F.asc("v"), F.expr("ask != 0"), F.asc("k"))),
        }
    )
    forward = found.where("ask = 1 and end is not null").select("doc", "hash", F.col("k").alias("line"), (F.col("end") - F.col("k")).alias("len"))
    backward = found.where("ask = -1 and start is not null").select("doc", "hash", F.col("start").alias("line"), (F.col("k") - F.col("start")).alias("len"))
    return forward.unionByName(backward).distinct()


def _ranked(positions: DataFrame, *key: str) -> DataFrame:
    """Positions whose key occurs twice or more, with a number that has the order of the keys."""
    repeated = positions.groupBy(*key).count().where(F.col("count") > 1)
    ranks = repeated.repartitionByRange(*key).sortWithinPartitions(*key).select(*key, F.monotonically_increasing_id().alias("number"))
    return stored(positions.join(stored(ranks), list(key)).select(*_AT, F.col("number").alias("rank")))


def prefix_doubling(lines: DataFrame, depth: int):
    """Yields ranks at depths 1, 2, 4, ... up to ``depth``: the suffixes that share so many lines with another."""
    active = _ranked(lines.select(*_AT, "x", "y"), "x", "y")
    size = 1
    while True:
        yield size, active
        size *= 2
        if size > depth:
            return
        ahead = active.select("doc", "hash", (F.col("line") - size // 2).alias("line"), F.col("rank").alias("next"))
        active = _ranked(active.join(ahead, _AT), "rank", "next")


def later_runs(lines: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, hash, line, len): repeated runs with an earlier copy."""
    runs = stored(shortest_runs(lines, least))
    deepest = runs.agg(F.coalesce(F.max("len"), F.lit(1))).first()[0]
    found = None
    for size, ranks in prefix_doubling(lines, deepest):
        of_size = runs.where((F.col("len") >= size) & (F.col("len") < 2 * size))
        tail = ranks.select("doc", "hash", (F.col("line")).alias("tail"), F.col("rank").alias("tail_rank"))
        named = stored(
            of_size.join(ranks, _AT).withColumn("tail", F.col("line") + F.col("len") - size)
            .join(tail, ["doc", "hash", "tail"]).select(*_AT, "len", "rank", "tail_rank")
        )
        place = F.struct(*_AT)
        interval = ["len", "rank", "tail_rank"]
        first = named.groupBy(*interval).agg(F.min(place).alias("first"), F.max(place).alias("last"))
        first = stored(first.where(F.col("first") != F.col("last")).drop("last"))
        later = stored(named.join(first, interval).where(place > F.col("first")).select(*_AT, "len"))
        found = later if found is None else found.unionByName(later)
        if ranks.isEmpty():
            break
    return found


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated runs, with ``n_lines``, ``n_removed_lines`` and the ``removed_lines`` (from 0)."""
    columns = [c for c in docs.columns if c not in ADDED]
    runs = later_runs(stored(line_ids(docs, doc_id, text)), least)
    gone = (
        runs.select("doc", "hash", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("len") - 1)).alias("line")).distinct()
        .groupBy("doc", "hash").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    )
    keys = _identity(F.col(f"`{doc_id}`"), F.col(f"`{text}`"))
    held = docs.select(F.struct(*[f"`{c}`" for c in columns]).alias("row"), *[value.alias(name) for name, value in keys.items()])
    joined = held.join(gone, ["doc", "hash"], "left")
    whole = F.col("row").getField(text)
    split = F.split(whole, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    kept = let(split, lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    new_text = F.when(F.size("gone") > 0, kept).otherwise(whole)
    return joined.select(
        *[(new_text if c == text else F.col("row").getField(c)).alias(c) for c in columns],
        F.when(whole.isNull(), F.lit(0)).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("removed_lines"),
    )
