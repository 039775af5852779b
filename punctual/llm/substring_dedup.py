r"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``LENGTH`` bytes, most significant digits first; groups that are equal to
that depth are exactly the repeated windows. A pass looks at some more bytes of each suffix that still has a
partner, and suffixes whose group has one member leave.

Every byte has a suffix, so they are handled in runs. The first digit is an ``ANCHOR`` of 64 bytes: of all
64-byte strings in a window the one with the smallest hash (winnowing), so equal windows have equal anchors at
the same distance. An anchor occurrence stands for the run of consecutive windows that chose it. Windows of a
run are numbered by their distance to the anchor, so parts of runs line up. Each pass looks at two strings of
a run: the bytes all its windows share (the digits so far) and the bytes they span. A run whose span occurs
twice is repeated throughout; one whose shared bytes occur once is not repeated at all; the others are split
into parts of ``PARTS`` windows for the next pass. In the last pass a part is one window.

Digits are compared by 128-bit hashes and counted by aggregation with a combine in the map tasks, so a string
that a third of all rows share is never gathered, and no pairs are made. Texts that are equal as a whole are
worked on once, as a text with a copy.

Null text is empty; texts shorter than ``LENGTH`` lose nothing; repeated rows are copies of each other; null
ids are kept as ids; an empty table gives an empty result; further columns stay (the names in ``ADDED`` are
replaced). Whole texts are used, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from punctual.llm.common import stored_lean as stored

LENGTH = 400
ANCHOR = 64
#: Windows in a run's parts, pass by pass; each number divides the one before.
PARTS = (49, 7, 1)
ADDED = ["n_bytes", "n_removed", "n_spans", "kept"]
#: Bytes of text worked on together in a task.
CHUNK = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _slide(values: np.ndarray, width: int, combine: np.ufunc, worst: int) -> np.ndarray:
    """``combine`` over every ``width`` consecutive values (van Herk: running from both ends of blocks)."""
    n = len(values)
    padded = np.full(-(-n // width) * width, worst, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = combine.accumulate(blocks, axis=1).ravel()
    right = combine.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return combine(right[: n - width + 1], left[width - 1 : n])


def anchor_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: first and last start, the anchor's place, its hash."""
    width = LENGTH - ANCHOR + 1
    place_bits = np.uint64(22)
    place_mask = np.uint64((1 << 22) - 1)
    parts = []
    # Chunks overlap by a window less a byte, so that each window lies in one.
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        raw = np.frombuffer(data, np.uint8, min(CHUNK + LENGTH - 1, len(data) - at), at)
        up, down = _powers(_BASE, len(raw)), _powers(_INVERSE, len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up)])
        h = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(raw) - ANCHOR + 1]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        # Hash and place in one number: the smallest is the leftmost of the smallest hashes.
        keyed = ((h >> place_bits) << place_bits) | np.arange(len(h), dtype=np.uint64)
        chosen = (_slide(keyed, width, np.minimum, np.iinfo(np.uint64).max) & place_mask).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:], len(chosen)) - 1
        parts.append((first + at, last + at, chosen[first] + at, h[chosen[first]]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(column) for column in zip(*parts))


def _run_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of each text, with the hash of the bytes that a run spans."""
    names, out = ["text_key", "first", "low", "high", "anchor", "span"], []
    for batch in batches:
        for key, text in zip(batch["text_key"], batch["text"]):
            data = text.encode("utf-8", "surrogatepass")
            first, last, place, own = anchor_runs(data)
            low = first - place + LENGTH - ANCHOR
            for f, l, u, h in zip(first.tolist(), last.tolist(), low.tolist(), own.view(np.int64).tolist()):
                out.append((key, f, u, u + l - f, h, xxhash.xxh3_128_digest(data[f : l + LENGTH])))
            if len(out) >= 50_000:
                yield pd.DataFrame(out, columns=names)
                out = []
    yield pd.DataFrame(out, columns=names)


def _span_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each open run."""
    for batch in batches:
        names, out, size = ["text_key", "first", "low", "high", "weight", "bytes"], [], 0
        for key, text, runs in zip(batch["text_key"], batch["text"], batch["runs"]):
            data = text.encode("utf-8", "surrogatepass")
            for run in runs:
                f, low, high = run["first"], run["low"], run["high"]
                out.append((key, f, low, high, run["weight"], data[f : f + high - low + LENGTH]))
                size += high - low + LENGTH
            if size > 1 << 23:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        yield pd.DataFrame(out, columns=names)


def _md5(data: Column) -> Column:
    return F.unhex(F.md5(data))


def _split(runs: DataFrame, part: int) -> DataFrame:
    """Each run cut where window numbers are multiples of ``part``, with the hashes of shared and spanned bytes."""
    cells = F.transform(
        F.sequence(F.floor(F.col("low") / part), F.floor(F.col("high") / part)),
        lambda k: F.struct(
            (k * part).cast("int").alias("cell"),
            F.greatest(k * part, F.col("low")).cast("int").alias("from"),
            F.least(k * part + part - 1, F.col("high")).cast("int").alias("to"),
        ),
    )
    cut = runs.select("run", "weight", F.col("low").alias("base"), "bytes", F.inline(cells))
    # What all windows of the whole cell share lies in every run that has a window of it.
    cell_end = F.least(F.col("cell") + part - 1, F.lit(LENGTH - ANCHOR))
    shared = F.substring("bytes", cell_end - F.col("base") + 1, F.lit(LENGTH) - (cell_end - F.col("cell")))
    spanned = F.substring("bytes", F.col("from") - F.col("base") + 1, F.col("to") - F.col("from") + LENGTH)
    return cut.select(
        "run", "weight", "cell", F.col("from").alias("low"), F.col("to").alias("high"),
        _md5(shared).alias("digits"), _md5(spanned).alias("span"),
    )


def _counted(rows: DataFrame, digits: list[str], one: Column) -> tuple[DataFrame, DataFrame]:
    """One pass. (repeated spans; a run for each span to go on with, ``weight`` its number of occurrences).

    Spans go on if something else has the same digits and at least one of these spans occurs only once; those
    that occur more often go on as its possible partners.
    """
    span = [*digits, "low", "high", "span"]
    counts = stored(rows.groupBy(*span).agg(F.sum("weight").alias("weight"), F.min(one).alias("one")))
    groups = counts.groupBy(*digits).agg(F.sum("weight").alias("all_runs"), F.min("weight").alias("rarest"))
    undecided = stored(groups.where("all_runs > 1 and rarest = 1").select(*digits))
    return counts.where("weight > 1").select(*span), counts.join(undecided, digits).select("one", "low", "high", "weight")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(text_key, start, end): byte ranges that repeated windows cover, over distinct ``texts`` (text_key, text)."""
    runs = stored(
        texts.mapInPandas(_run_rows, "text_key binary, first long, low int, high int, anchor long, span binary")
        .withColumn("weight", F.lit(1).cast("long"))
    )
    repeated, going_on = _counted(runs, ["anchor"], F.struct("text_key", "first"))
    covered = stored(runs.join(repeated, ["anchor", "low", "high", "span"]).select("text_key", "first", (F.col("first") + F.col("high") - F.col("low") + LENGTH).alias("end")))
    wanted = going_on.select("one.text_key", F.struct("one.first", "low", "high", "weight").alias("run"))
    wanted = stored(wanted.groupBy("text_key").agg(F.collect_list("run").alias("runs")))
    spans = stored(
        texts.join(wanted, "text_key").select("text_key", "text", "runs")
        .mapInPandas(_span_rows, "text_key binary, first long, low int, high int, weight long, bytes binary")
        .withColumn("run", F.monotonically_increasing_id())
    )
    places = spans.select("run", "text_key", "first", F.col("low").alias("run_low"))
    open_runs = spans.select("run", "low", "high", "weight", "bytes")
    for part in PARTS:
        rows = _split(open_runs, part)
        repeated, going_on = _counted(rows, ["cell", "digits"], F.col("run"))
        own = rows.where("weight = 1").join(repeated, ["cell", "digits", "low", "high", "span"]).select("run", "low", "high")
        start = F.col("first") + F.col("low") - F.col("run_low")
        found = own.join(places, "run").select("text_key", start.alias("first"), (start + F.col("high") - F.col("low") + LENGTH).alias("end"))
        covered = covered.unionByName(stored(found))
        if part > 1:
            left = going_on.select(F.col("one").alias("run"), F.col("low").alias("from"), F.col("high").alias("to"), F.col("weight").alias("times"))
            open_runs = stored(
                spans.select("run", "low", "bytes").join(left, "run").select(
                    "run", F.col("from").alias("low"), F.col("to").alias("high"), F.col("times").alias("weight"),
                    F.substring("bytes", F.col("from") - F.col("low") + 1, F.col("to") - F.col("from") + LENGTH).alias("bytes"),
                )
            )
    return covered.withColumnRenamed("first", "start")


def _cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts without the covered bytes."""
    for batch in batches:
        out = []
        for key, text, ranges in zip(batch["text_key"], batch["text"], batch["ranges"]):
            data = text.encode("utf-8", "surrogatepass")
            kept, at, removed, spans, end_before = [], 0, 0, 0, -1
            for start, end in sorted((r["start"], r["end"]) for r in ranges):
                if start > end_before:
                    kept.append(data[at:start])
                    spans += 1
                if end > at:
                    removed += end - max(start, at)
                    at = end
                end_before = max(end_before, end)
            kept.append(data[at:])
            out.append((key, removed, spans, b"".join(kept)))
        yield pd.DataFrame(out, columns=["text_key", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without their text column, with ``n_bytes``, ``n_removed``, ``n_spans`` and the ``kept`` bytes."""
    columns = [c for c in docs.columns if c != text and c not in ADDED]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(F.struct(F.lit(0), *[f"`{c}`" for c in columns]).alias("row"), whole.alias("text"), _md5(whole.cast("binary")).alias("text_key"))
    texts = stored(
        keyed.where(F.octet_length("text") >= LENGTH)
        .groupBy("text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    ranges = repeated_windows(texts.select("text_key", "text"))
    # A text with a copy is covered throughout.
    copied = texts.where("copies > 1").select("text_key", F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"))
    by_text = stored(ranges.unionByName(copied).groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    cut = stored(
        texts.join(by_text, "text_key").select("text_key", "text", "ranges")
        .mapInPandas(_cut_rows, "text_key binary, n_removed long, n_spans long, kept binary")
    )
    return keyed.join(cut, "text_key", "left").select(
        *[F.col("row").getField(c).alias(c) for c in columns],
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept", F.col("text").cast("binary")).alias("kept"),
    )
