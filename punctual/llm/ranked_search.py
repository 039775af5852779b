"""Ranked lexical search in a K2-treap over the grid of terms and documents.

1. **Terms**, one pass over all texts: each document's count of terms and its counts of the items' terms are stored; the
   rest of its terms would never be looked up. Items travel as a broadcast of bounded size: beyond ``ITEM_BYTES`` of text
   they are dealt into slices by hash, one pass each.
2. **Index**: blocks of ``BLOCK`` documents, shortest first inside a block, become grids with a row per term (most frequent
   first, so that cells hold alike impacts) and a column per document. A grid is a K2 tree: every cell of 2**k by 2**k that is not empty keeps four bits that
   say which of its quarters are not empty, and the largest impact inside, stored as what it lacks to the largest of the cell above. Blocks are rows of a table.
3. **Search**, best-first, of every block for every item: a state is a range of documents with, for each of the item's terms,
   the cell that its row path has reached; the paths go down together. The bound of a state is the sum of the weighted maxima
   of its cells. The states of highest bound are split first, ``AT_ONCE`` at a time, until no bound reaches the score of the
   last document to be returned. Scores of single documents are exact. A task keeps the best documents of each item over all its blocks, so it sends
   ``most`` rows per item at most; ranks come from a window that prunes before the shuffle.

Numbers are whole numbers of 64 bits. Null and empty texts, and texts without a term, are not documents; items without a term,
or whose terms are in no document, give no row. Repeated rows of documents are ranked each; repeated items are answered
each. Equal scores go by key, missing keys last. Empty tables give no rows. A text is taken in pieces of ``PIECE`` bytes between terms. Only keys and texts are read, so further columns
of any name do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from punctual.llm.common import stored

#: Letters and digits of ASCII, capitals made small, and every byte of other characters; the rest parts terms.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)
ITEM_BYTES = 32 << 20
PIECE = 1 << 20
#: Documents of a block, and the term counts from which on a block is closed early.
BLOCK = 1 << 13
POSTINGS = 1 << 21
AT_ONCE = 128
_NO_KEY = np.iinfo(np.int64).max


def terms(text: str | None) -> Counter[bytes]:
    """Terms of a text, as UTF-8, with how often they occur."""
    data = (text or "").encode("utf-8", "replace").translate(_BYTES)
    if len(data) <= PIECE:
        return Counter(data.split())
    found: Counter[bytes] = Counter()
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        found.update(data[start:end].split())
        start = end
    return found


@dataclass(frozen=True)
class Items:
    """A slice of the items: texts by number, their terms (row of the grid, repeats) and the grid's rows by term."""

    texts: list[str]
    rows: list[np.ndarray]
    repeats: list[np.ndarray]
    row_of: dict[bytes, int]


def _slice(items: list[str]) -> Items:
    row_of: dict[bytes, int] = {}
    counts = [terms(t) for t in items]
    rows = [np.array([row_of.setdefault(t, len(row_of)) for t in c], np.int64) for c in counts]
    return Items(items, rows, [np.array(list(c.values()), np.int64) for c in counts], row_of)


# Terms of the documents


def _postings(docs: DataFrame, row_of: dict[bytes, int]) -> DataFrame:
    """``key``, ``n`` (terms with repeats) and the counts of known terms, for documents with a term; stored."""
    shared = docs.sparkSession.sparkContext.broadcast(row_of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            places, sizes, rows, counts = [], [], [], []
            for place, text in enumerate(batch.column(1)):
                found = terms(text.as_py())
                if found:
                    mine = [(known[t], c) for t, c in found.items() if t in known]
                    places.append(place)
                    sizes.append(found.total())
                    rows.append(np.array([r for r, _ in mine], np.int32).tobytes())
                    counts.append(np.array([c for _, c in mine], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places, pa.int64())), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary()), pa.array(counts, pa.binary())],
                names=["key", "n", "rows", "counts"],
            )

    return stored(docs.mapInArrow(count, "key long, n long, rows binary, counts binary"))


def _holders(postings: DataFrame, n_rows: int) -> np.ndarray:
    """How many documents hold each term."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_rows, np.int64)
        for batch in batches:
            held += np.bincount(_joined(batch.column(0), np.int32), minlength=n_rows)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"row": pa.array(used), "df": pa.array(held[used])})

    # One row per term of the items in this slice.
    found = postings.select("rows").mapInArrow(partial, "row long, df long").groupBy("row").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(n_rows, np.int64)
    out[found["row"].to_numpy(np.int64)] = found["df"]
    return out


def _joined(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What one occurrence weight is multiplied with; below a million."""
    if 25 * int(lengths.max(initial=0)) * n_docs < 2**62:
        share = 25 * lengths * n_docs // n_terms
    else:
        share = np.array([25 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 12 * (75 + share))


# The tree of a block


class K2Treap:
    """Cells by level, from the whole grid down to single entries; a level's cells are in Morton order.

    ``children[k][4 * cell + quarter]`` is the cell's quarter on level k + 1, or the level's last number, which stands
    for all empty cells and has maximum 0. Quarters: 2 * lower half of the rows + later half of the columns.
    """

    def __init__(self, maxima: list[np.ndarray], bits: list[np.ndarray]):
        self.height = len(bits)
        self.maxima = [np.append(m, 0) for m in maxima]
        self.children = []
        for bit, below in zip(bits, maxima[1:]):
            into = np.where(bit, np.cumsum(bit) - 1, len(below)).astype(np.int32)
            self.children.append(np.append(into, np.full(4, len(below), np.int32)))

    @staticmethod
    def build(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> K2Treap:
        top = max(int(rows.max()), int(columns.max()), 1)
        height = top.bit_length()
        code = np.zeros(len(rows), np.int64)
        for k in range(height):
            code |= ((rows >> k & 1) << (2 * k + 1)) | ((columns >> k & 1) << (2 * k))
        order = np.argsort(code)
        code, level = code[order], values[order]
        maxima, bits = [level], []
        for _ in range(height):
            above = code >> 2
            starts = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            held = np.zeros((len(starts), 4), bool)
            held[np.cumsum(np.append(False, above[1:] != above[:-1])), code & 3] = True
            level, code = np.maximum.reduceat(level, starts), above[starts]
            maxima.append(level)
            bits.append(held.ravel())
        return K2Treap(maxima[::-1], bits[::-1])

    def to_bytes(self) -> tuple[list[bytes], list[bytes]]:
        """Quarters' bits by level, and maxima: that of the whole grid, then what each cell lacks to the one above."""
        bits, lacks = [], [self.maxima[0][:-1].astype(np.uint32).tobytes()]
        for k, into in enumerate(self.children):
            held = into[:-4] < len(self.maxima[k + 1]) - 1
            bits.append(np.packbits(held).tobytes())
            parents = np.repeat(self.maxima[k][:-1], 4)[held]
            lacks.append((parents - self.maxima[k + 1][:-1]).astype(np.uint32).tobytes())
        return bits, lacks

    @staticmethod
    def from_bytes(bits: list[bytes], lacks: list[bytes]) -> K2Treap:
        maxima, held = [np.frombuffer(lacks[0], np.uint32).astype(np.int64)], []
        for packed, lack in zip(bits, lacks[1:]):
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=4 * len(maxima[-1])).astype(bool)
            held.append(bit)
            maxima.append(np.repeat(maxima[-1], 4)[bit] - np.frombuffer(lack, np.uint32).astype(np.int64))
        return K2Treap(maxima, held)

    def best(self, rows: np.ndarray, weights: np.ndarray, keys: np.ndarray, most: int, found: Found) -> None:
        """Adds to ``found`` every column that belongs to the best ``most`` by weighted sum of its entries in ``rows``."""
        fits = rows < 1 << self.height
        rows, weights = rows[fits], weights[fits]
        if not len(rows):
            return
        # By level: bounds, first column (in cells of that level), and cells by term.
        pools: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(self.height + 1)]
        pools[0] = [(weights.sum(keepdims=True) * self.maxima[0][0], np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32))]
        tops = np.full(self.height + 1, -1, np.int64)
        tops[0] = pools[0][0][0][0]
        while True:
            # Of equal bounds the deeper level.
            level = self.height - int(np.argmax(tops[::-1]))
            if tops[level] <= 0 or tops[level] < found.least:
                return
            bounds, ranges, cells = (np.concatenate(x) for x in zip(*pools[level]))
            alive = np.flatnonzero(bounds >= max(found.least, 1))
            if len(alive) > AT_ONCE:
                split = np.argpartition(-bounds[alive], AT_ONCE)
                now, later = alive[split[:AT_ONCE]], alive[split[AT_ONCE:]]
            else:
                now, later = alive, alive[:0]
            pools[level] = [(bounds[later], ranges[later], cells[later])] if len(later) else []
            tops[level] = bounds[later].max(initial=-1)
            half = (rows >> (self.height - 1 - level) & 1) * 2
            for side in (0, 1):
                into = self.children[level][4 * cells[now] + (half + side)]
                bound = self.maxima[level + 1][into] @ weights
                place = 2 * ranges[now] + side
                left = bound >= max(found.least, 1)
                if level + 1 == self.height:
                    found.add(bound[left], keys[place[left]])
                elif left.any():
                    pools[level + 1].append((bound[left], place[left], into[left]))
                    tops[level + 1] = max(tops[level + 1], int(bound[left].max()))


class Found:
    """The best ``most`` (score, key) of an item so far; ``least`` is the score a document must reach."""

    def __init__(self, most: int):
        self.most, self.least = most, 0
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        if not len(scores):
            return
        scores, keys = np.concatenate([self.scores, scores]), np.concatenate([self.keys, keys])
        order = np.lexsort((keys, -scores))[: self.most]
        self.scores, self.keys = scores[order], keys[order]
        if len(order) == self.most:
            self.least = int(self.scores[-1])


# Index and search in Spark


def _index(postings: DataFrame, place_of: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks: ``keys`` by column, and the tree's bits and maxima by level; stored."""
    places = postings.sparkSession.sparkContext.broadcast(place_of)

    def block(keys: list[np.ndarray], sizes: list[np.ndarray], rows: list[np.ndarray], lengths: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        n, held = np.concatenate(sizes), np.concatenate(lengths)
        order = np.argsort(n, kind="stable")
        column = np.empty(len(n), np.int64)
        column[order] = np.arange(len(n))
        value = impacts(np.concatenate(counts).astype(np.int64), np.repeat(n, held), n_docs, n_terms)
        bits, maxima = K2Treap.build(places.value[np.concatenate(rows)], np.repeat(column, held), value).to_bytes()
        of_list = pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([np.concatenate(keys)[order].tobytes()], pa.binary()), pa.array([bits], of_list), pa.array([maxima], of_list)],
            names=["keys", "bits", "maxima"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        n = postings_n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(2)
                lengths = np.array([len(r) // 4 for r in column.to_pylist()], np.int64)
                parts.append(
                    (part.column(0).fill_null(_NO_KEY).to_numpy(), part.column(1).to_numpy(), _joined(column, np.int32), lengths, _joined(part.column(3), np.int32))
                )
                n, postings_n = n + part.num_rows, postings_n + int(lengths.sum())
                if n >= BLOCK or postings_n >= POSTINGS:
                    if postings_n:
                        yield block(*map(list, zip(*parts)))
                    parts, n, postings_n = [], 0, 0
        if postings_n:
            yield block(*map(list, zip(*parts)))

    return stored(postings.mapInArrow(build, "keys binary, bits array<binary>, maxima array<binary>"))


def _search(index: DataFrame, items: Items, weights: np.ndarray, place_of: np.ndarray, most: int) -> DataFrame:
    """``item`` (number in the slice), ``doc``, ``score`` of what can be among the best."""
    shared = index.sparkSession.sparkContext.broadcast(
        [(place_of[rows], weights[rows] * repeats) for rows, repeats in zip(items.rows, items.repeats)]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Found(most) for _ in shared.value]
        for batch in batches:
            for keys, bits, maxima in zip(*batch.columns):
                tree = K2Treap.from_bytes(bits.as_py(), maxima.as_py())
                columns = np.frombuffer(keys.as_buffer(), np.int64)
                # Columns beyond the last document are never reached: their cells are empty.
                for own, (rows, weight_) in zip(found, shared.value):
                    tree.best(rows, weight_, columns, most, own)
        docs = np.concatenate([f.keys for f in found]) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict(
            {
                "item": pa.array(np.repeat(np.arange(len(found)), [len(f.keys) for f in found])),
                "doc": pa.array(docs, mask=docs == _NO_KEY),
                "score": pa.array(np.concatenate([f.scores for f in found]) if found else np.zeros(0, np.int64)),
            }
        )

    return index.mapInArrow(search, "item long, doc long, score long")


def search(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, most: int = 20) -> DataFrame:
    """``item``, ``rank``, ``doc`` and ``score``: the ``most`` best documents of each item. Document keys are LONG."""
    texts = items.select(F.col(f"`{item_text}`").alias("text")).dropna().distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(total / ITEM_BYTES))
    documents = docs.select(F.col(f"`{doc_key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    answers = []
    for k in range(slices):
        # About ITEM_BYTES of text.
        part = [r["text"] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).collect()]
        answers.append(_answers(documents, _slice(sorted(part)), most))
    best = answers[0]
    for more in answers[1:]:
        best = best.unionByName(more)
    out = asked.join(best, "text")
    return out.select("item", "rank", "doc", "score")


def _answers(documents: DataFrame, items: Items, most: int) -> DataFrame:
    """``text``, ``rank``, ``doc`` and ``score`` of a slice."""
    spark = documents.sparkSession
    postings = _postings(documents, items.row_of)
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = _holders(postings, len(items.row_of))
    weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
    place_of = np.empty(len(df), np.int64)
    place_of[np.argsort(-df, kind="stable")] = np.arange(len(df))
    index = _index(postings, place_of, n_docs, n_terms or 1)
    found = stored(_search(index, items, weights, place_of, most))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    numbers = spark.createDataFrame([(k, t) for k, t in enumerate(items.texts)], "item long, text string")
    return ranked.join(numbers, "item").select("text", "rank", "doc", "score")
