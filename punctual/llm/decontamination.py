"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

The index holds the test items, long ones in units of ``UNIT`` words; every training passage (``2 * UNIT``
words, starting every ``UNIT`` words, so each unit lies whole inside one) is a query. BM25 weights are divided
by the unit's score for its own text, so 1 means that the passage holds all of the unit's terms, and all units
above ``THRESHOLD`` are retrieved, without a top-k.

Posting lists are ordered by unit and cut into blocks of ``BLOCK`` units; a term's largest weight in each
block bounds what the block can give. Those bounds are summed for a whole batch of passages at once; passages
with no block above the threshold are done. For the rest, WAND walks the lists of the blocks left, skipping
units whose terms cannot reach the threshold, and gives exact scores.

Each hit is verified against the document's words around the passage: enough of the question's and of the
answer's word n-grams must occur there.

The index is split into shards of at most ``SHARD_UNITS`` units, each broadcast by itself: a shard has at most
``SHARD_UNITS * UNIT`` postings and ``SHARD_UNITS / BLOCK`` bounds for each of at most as many terms. Every
shard is put to all passages.

A null or empty text or item has no words and is in no result. Repeated items are found each; repeated
documents each give rows; null ids are kept as null; an empty table on either side gives an empty result.
Whole texts are read, whatever their length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from punctual.llm.common import stored

UNIT = 64
BLOCK = 4
THRESHOLD = 0.5
SHARD_UNITS = 2048
K1, B = 1.2, 0.75
#: Shares of the n-grams of question and answer that must be found, and the n.
QUESTION_SHARE, ANSWER_SHARE, GRAM = 0.5, 0.5, 3

HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word int"
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(tokens: list[str]) -> set[tuple[str, ...]]:
    """Word n-grams; of a shorter text, the whole of it."""
    n = min(GRAM, len(tokens))
    return {tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1)} if n else set()


class Terms(dict):
    """Numbers of the indexed terms; -1 for all others."""

    def __missing__(self, term: str) -> int:
        return -1


_next_unit = itemgetter(0)


@dataclass
class Index:
    """One shard: units by number, and the posting list of each term."""

    items: list[tuple[int | None, set, set, int]]  # id, n-grams of question and answer, words of the item
    unit_item: list[int]
    terms: "Terms"
    units: list[list[int]]  # of each term: ascending units
    weights: list[list[float]]
    bounds: np.ndarray  # term x block: largest weight


def build_index(rows: list[tuple[int | None, str | None, str | None]], document_share: dict[str, float], mean_length: float) -> Index:
    """Index of (id, question, answer) rows. ``document_share``: in which share of all items each term occurs."""
    items, unit_item, units = [], [], []
    for item_id, question, answer in rows:
        q, a = words(question), words(answer)
        both = q + a
        if not both:
            continue
        items.append((item_id, grams(q), grams(a), len(both)))
        for at in range(0, len(both), UNIT):
            units.append(both[at : at + UNIT])
            unit_item.append(len(items) - 1)
    terms = Terms()
    postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
    for number, unit in enumerate(units):
        scored = {}
        for term, tf in Counter(unit).items():
            idf = math.log(1 + 1 / max(document_share.get(term, 1e-3), 1e-9))
            scored[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(unit) / mean_length))
        own = sum(scored.values())
        for term, score in scored.items():
            postings[terms.setdefault(term, len(terms))].append((number, score / own))
    blocks = max(1, -(-len(units) // BLOCK))
    bounds = np.zeros((max(1, len(terms)), blocks), np.float32)
    lists, weights = [], []
    for term in range(len(terms)):
        numbers, values = zip(*postings[term])
        lists.append(list(numbers))
        weights.append(list(values))
        np.maximum.at(bounds[term], np.array(numbers) // BLOCK, values)
    return Index(items, unit_item, terms, lists, weights, bounds)


def wand(index: Index, query: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
    """(unit, score) of all units of a block that reach the threshold for the distinct terms of ``query``."""
    hits = []
    cursors = []  # [next unit, place in the list, end, units, weights, bound]
    for term in query:
        bound = index.bounds[term, block]
        if bound > 0:
            own = index.units[term]
            start, end = bisect_left(own, block * BLOCK), bisect_left(own, (block + 1) * BLOCK)
            cursors.append([own[start], start, end, own, index.weights[term], float(bound)])
    while cursors:
        cursors.sort(key=_next_unit)
        total, pivot = 0.0, None
        for cursor in cursors:
            total += cursor[5]
            if total >= threshold - 1e-6:
                pivot = cursor[0]
                break
        if pivot is None:
            break
        if cursors[0][0] == pivot:
            score = 0.0
            for cursor in cursors:
                if cursor[0] != pivot:
                    break
                score += cursor[4][cursor[1]]
                cursor[1] += 1
            if score >= threshold:
                hits.append((pivot, score))
        else:
            for cursor in cursors:
                if cursor[0] >= pivot:
                    break
                cursor[1] = bisect_left(cursor[3], pivot, cursor[1], cursor[2])
        cursors = [c for c in cursors if c[1] < c[2]]
        for cursor in cursors:
            cursor[0] = cursor[3][cursor[1]]
    return hits


def search(index: Index, texts: list[list[str]], threshold: float = THRESHOLD) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(number of the text, item, score, overlaps, first word of the passage): for each text and item the best verified passage."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter(map(index.terms.__getitem__, chain.from_iterable(texts)), np.int32, int(lengths.sum()))
    text_at = np.concatenate([[0], np.cumsum(lengths // UNIT + 1)])  # passages before each text
    known = np.flatnonzero(flat >= 0)
    number = np.repeat(np.arange(len(texts)), lengths)[known]
    part = (known - np.repeat(np.cumsum(lengths) - lengths, lengths)[known]) // UNIT
    key = (text_at[number] + part) * len(index.bounds) + flat[known]
    # A word stands in the passage that starts with its part, and in the one before.
    pairs = np.unique(np.concatenate([key, key[part > 0] - len(index.bounds)]))
    if not len(pairs):
        return
    passages, terms = pairs // len(index.bounds), (pairs % len(index.bounds)).astype(np.int32)
    starts = np.flatnonzero(np.diff(passages, prepend=-1))
    ends = np.append(starts[1:], len(passages))
    best: dict[tuple[int, int], tuple] = {}
    for lo in range(0, len(starts), 2048):
        own_starts = starts[lo : lo + 2048]
        first, last = own_starts[0], ends[min(lo + 2048, len(starts)) - 1]
        sums = np.add.reduceat(index.bounds[terms[first:last]], own_starts - first, axis=0)
        near = sums >= threshold - 1e-4
        for row, block in zip(*np.nonzero(near)):
            k = lo + row
            passage = passages[starts[k]]
            for unit, score in wand(index, terms[starts[k] : ends[k]].tolist(), int(block), threshold):
                item = index.unit_item[unit]
                number = int(np.searchsorted(text_at, passage, "right") - 1)
                start = int(passage - text_at[number]) * UNIT
                _, question, answer, length = index.items[item]
                around = texts[number][max(0, start - length) : start + 2 * UNIT + length]
                q, a = overlap(question, around), overlap(answer, around)
                if q >= QUESTION_SHARE and a >= ANSWER_SHARE and score > best.get((number, item), (0.0,))[0]:
                    best[number, item] = (score, q, a, start)
    for (number, item), (score, q, a, start) in sorted(best.items()):
        yield number, item, score, q, a, start


def overlap(wanted: set[tuple[str, ...]], tokens: list[str]) -> float:
    """The share of the wanted n-grams that the tokens have; 1 if none is wanted."""
    if not wanted:
        return 1.0
    n = len(next(iter(wanted)))
    return len(wanted & {tuple(tokens[k : k + n]) for k in range(len(tokens) - n + 1)}) / len(wanted)


def find_leaks(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, question: Column, answer: Column
) -> DataFrame:
    """One row per document and test item found in it, with the best passage."""
    spark = docs.sparkSession
    bank = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), question.alias("q"), answer.alias("a"))
    # Statistics are those of all items; each shard takes the part it needs.
    tokens = F.expr(r"regexp_extract_all(lower(concat_ws(' ', q, a)), '[\\p{L}\\p{N}_]+', 0)")
    sized = bank.withColumn("terms", tokens).withColumn("units", F.ceil(F.size("terms") / UNIT))
    n_units, n_words, n_items = sized.agg(
        F.coalesce(F.sum("units"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.count(F.lit(1))
    ).first()
    # Hashing puts half of SHARD_UNITS into a shard on average.
    shards = max(1, math.ceil(2 * n_units / SHARD_UNITS))
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("id", "q", "a"), F.lit(shards)))
    used = sharded.select("shard", F.explode(F.array_distinct("terms")).alias("term")).groupBy("shard", "term").count()
    everywhere = used.groupBy("term").agg((F.sum("count") / max(1, n_items)).alias("share"))
    shares = stored(used.join(everywhere, "term").select("shard", "term", "share"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    results = None
    for shard in range(shards):
        own = sharded.where(F.col("shard") == shard).select("id", "q", "a").orderBy("id", "q", "a").collect()
        share = {r["term"]: r["share"] for r in shares.where(F.col("shard") == shard).collect()}
        index = build_index([tuple(r) for r in own], share, max(1.0, n_words / max(1, n_units)))
        hits = rows.mapInPandas(_searcher(spark.sparkContext.broadcast(index)), HITS)
        results = hits if results is None else results.unionByName(hits)
    return results


def _searcher(shared):
    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = shared.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                ids = [None if pd.isna(i) else int(i) for i in part["doc_id"]]
                hits = search(index, [words(t) for t in part["text"]])
                found = [(ids[n], index.items[item][0], score, q, a, start) for n, item, score, q, a, start in hits]
                frame = pd.DataFrame(found, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    return searched


def last_sentence(text: Column) -> tuple[Column, Column]:
    """Question and answer of an item that is one text: all but its last sentence, and that sentence."""
    pattern = r"(?s)^(.*[.!?\n])\s*(\S.*?)\s*$"
    whole = F.coalesce(text, F.lit(""))
    question, answer = F.regexp_extract(whole, pattern, 1), F.regexp_extract(whole, pattern, 2)
    return F.when(answer == "", whole).otherwise(question), answer
