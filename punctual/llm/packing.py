"""Packing of documents into token sequences by order-preserving dynamic programming.

Documents stay in the order of the table. A stream of them (one Spark partition of the table) is cut into
windows of at most ``LENGTH`` tokens; cuts lie after a document, after a sentence, or, inside a sentence
longer than ``STRIDE`` tokens, at every multiple of ``STRIDE``. With ``cost(cut)`` the least total up to a
cut, ``cost(j) = penalty(j) + min over i of cost(i) + LENGTH - (pos(j) - pos(i))`` for cuts i at most
``LENGTH`` tokens before j. ``cost(i) + pos(i)`` does not depend on j, so the minimum is that of a sliding
window, kept in a monotone queue: one pass.

A stream is planned in blocks of ``BLOCK`` tokens; after each, the cheapest cut among the last window's is
fixed and the rest carried into the next block, so memory is bounded however long a stream or document is.
The rest at the end of a stream becomes sequences whose lengths are powers of two and need no padding.

Tokens come from a public tokenizer file, without special tokens, plus ``END`` after each document. A text
is split at blanks, which this tokenizer drops anyway, and each distinct piece is encoded once; the ids are
those of the whole text.

Null and empty texts give the end token alone; repeated rows and repeated or null ids are separate documents;
an empty table gives an empty result. Sequence ids carry the partition, so a task that runs again gives the
same rows.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LENGTH = 4096
END = 2
STRIDE = 24
BLOCK = 1 << 20
#: In tokens of padding: what a cut inside a document costs, after a sentence and elsewhere.
SENTENCE_PENALTY, TOKEN_PENALTY = 2.0, 6.0
CACHE = 1_200_000
#: A mark of these behind letters is a token of its own.
MARKS = ",.;:!?"
SENTENCE_ENDS = ".!?。！？…"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Numbers(dict):
    """Numbers of pieces by first appearance; ``fresh`` collects those not met before."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


_NOTHING = np.zeros(0, np.uint32), np.zeros(0, np.int64)


class _Ids:
    """The ids of numbered strings, one after another."""

    def __init__(self) -> None:
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, flat])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these strings in a row, and where each string's end."""
        first = self.starts[numbers]
        lengths = self.starts[numbers + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(first - (ends - lengths), lengths) + np.arange(total)], ends


def _plain(letters: str) -> bool:
    """Letters of Latin that are one letter also in lower case."""
    return max(letters) < "\u0250" and "\u0130" not in letters


class PieceEncoder:
    """Ids of texts by a tokenizer that treats parts between blanks apart; distinct parts are encoded once.

    A piece of Latin letters with one mark behind it, as most are, is taken as two units, its letters in lower case
    where that is plain ASCII; units of letters are encoded many at once, as each ends with an end-of-word id. Other
    letters stay with their mark, as the tokenizer may make a letter and a combining sign of one. Strings of the tokenizer's
    special tokens get the ids that the tokenizer gives them.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.word_ends[number] = token.endswith("</w>")
            if len(token.removesuffix("</w>")) == 1 and token[0] in SENTENCE_ENDS:
                self.sentence_ends[number] = True
        self._clear()

    def _clear(self) -> None:
        self.pieces, self.units = _Numbers(), _Numbers()
        self.piece_ids, self.unit_ids = _Ids(), _Ids()

    def _one_by_one(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(lengths.sum())), lengths

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters, joined by blanks."""
        groups = [" ".join(words[at : at + 128]) for at in range(0, len(words), 128)]
        encoded = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.uint32)
        lengths = np.diff(np.flatnonzero(self.word_ends[ids]), prepend=-1)
        # A letter whose lower case is more than a letter makes two words of one.
        return (ids, lengths) if len(lengths) == len(words) else self._one_by_one(words)

    def _learn(self) -> None:
        """Ids of the fresh pieces from those of their units."""
        unit_of = self.units.__getitem__
        parts, counts = [], []
        for piece in self.pieces.fresh:
            stem, mark = (piece[:-1], piece[-1]) if len(piece) > 1 and piece[-1] in MARKS else (piece, "")
            if not (stem.isalpha() and (stem.isascii() or _plain(stem))):
                stem, mark = piece, ""
            parts.append(unit_of(stem.lower() if stem.isascii() and stem.isalpha() else stem))
            if mark:
                parts.append(unit_of(mark))
            counts.append(2 if mark else 1)
        fresh = self.units.fresh
        words = [u for u in fresh if u.isalpha()]
        others = [u for u in fresh if not u.isalpha()]
        if fresh:
            (word_flat, word_lengths), (other_flat, other_lengths) = self._together(words) if words else _NOTHING, self._one_by_one(others) if others else _NOTHING
            # Back to the order of the numbers.
            joined = _Ids()
            joined.add(np.concatenate([word_flat, other_flat]), np.concatenate([word_lengths, other_lengths]))
            at_word, at_other, order = 0, len(words), []
            for unit in fresh:
                if unit.isalpha():
                    order.append(at_word)
                    at_word += 1
                else:
                    order.append(at_other)
                    at_other += 1
            flat, ends = joined.of(np.array(order))
            self.unit_ids.add(flat, np.diff(ends, prepend=0))
            fresh.clear()
        flat, ends = self.unit_ids.of(np.array(parts))
        last_parts = np.cumsum(counts) - 1
        self.piece_ids.add(flat, np.diff(ends[last_parts], prepend=0))
        self.pieces.fresh.clear()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end token included."""
        if len(self.pieces) > CACHE:
            self._clear()
        number_of = self.pieces.__getitem__
        numbers = []
        for text in texts:
            pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            numbers.append(np.fromiter(map(number_of, pieces), np.int64, len(pieces)))
        if self.pieces.fresh:
            self._learn()
        return [np.append(self.piece_ids.of(number)[0], np.uint32(END)) for number in numbers]


@cache
def _encoder(path: str) -> PieceEncoder:
    """One for each Python worker, so that its later tasks find known pieces."""
    return PieceEncoder(path)


def cut_places(ids: list[np.ndarray], sentence_ends: np.ndarray, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending token places where a window may end, and the penalty of each. ``starts``: tokens of a document before its ids."""
    places, penalties, at = [], [], 0
    for own, start in zip(ids, starts):
        inner = np.flatnonzero(sentence_ends[np.minimum(own[:-1], len(sentence_ends) - 1)]) + 1
        inner = inner[inner < len(own)]
        strides = np.arange(STRIDE - start % STRIDE, len(own), STRIDE)
        # A stride place counts only where its sentence is longer than the stride.
        bounds = np.concatenate([[0], inner, [len(own)]])
        which = np.searchsorted(bounds, strides, "right") - 1
        strides = strides[(bounds[which + 1] - bounds[which] > STRIDE) & (bounds[which] < strides)]
        place = np.concatenate([inner, strides, [len(own)]])
        penalty = np.concatenate([np.full(len(inner), SENTENCE_PENALTY), np.full(len(strides), TOKEN_PENALTY), [0.0]])
        order = np.argsort(place, kind="stable")
        places.append(place[order] + at)
        penalties.append(penalty[order])
        at += len(own)
    return np.concatenate(places), np.concatenate(penalties)


def plan_cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the windows of least cost over all tokens, the last of them any cut that a further window could follow.

    Places are at most ``length`` apart. The monotone queue holds cuts whose ``cost + pos`` rises.
    """
    pos = [0, *places.tolist()]
    pen = [0.0, *penalties.tolist()]
    cost, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[int] = deque([0])
    for j in range(1, len(pos)):
        here = pos[j]
        while pos[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        cost[j] = pen[j] + cost[i] + length - (here - pos[i])
        back[j] = i
        key = cost[j] + here
        while queue and cost[queue[-1]] + pos[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    # What follows the last cut is packed later: its padding counts as that of an average window would, as none.
    last = len(pos) - 1
    first = max(1, bisect_left(pos, pos[last] - length))
    j = min(range(first, last + 1), key=lambda k: (cost[k], -pos[k]))
    ends = []
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Stream:
    """Buffers documents, plans windows and gives the pieces of finished sequences."""

    def __init__(self, encoder: PieceEncoder, partition: int) -> None:
        self.encoder, self.next_sequence = encoder, partition << 33
        self.docs: deque[tuple[object, np.ndarray, int, int]] = deque()  # id, ids left, their start, tokens of the document
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.tokens += len(ids)

    def emit(self, length: int) -> None:
        offset = 0
        while offset < length:
            doc_id, ids, start, total = self.docs.popleft()
            take = min(len(ids), length - offset)
            self.rows.append((doc_id, start, take, ids[:take].astype("<u4").tobytes(), total, self.next_sequence, offset))
            if take < len(ids):
                self.docs.appendleft((doc_id, ids[take:], start + take, total))
            offset += take
        self.next_sequence += 1
        self.tokens -= length

    def pack(self, final: bool) -> None:
        """Plans what is buffered; all of it if final."""
        while self.tokens > (LENGTH if final else 2 * LENGTH):
            places, penalties = cut_places([d[1] for d in self.docs], self.encoder.sentence_ends, [d[2] for d in self.docs])
            before = 0
            for end in plan_cuts(places, penalties):
                self.emit(end - before)
                before = end
            if not final:
                break
        if final:
            for length in _powers(self.tokens):
                self.emit(length)

    def taken(self) -> pd.DataFrame:
        frame = pd.DataFrame(self.rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        self.rows = []
        return frame


def pack(docs: DataFrame, doc_id: str, text: str, tokenizer_path: str) -> DataFrame:
    """The pieces: which ids of which document stand where in which sequence. ``ids`` are little-endian 32-bit."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = _Stream(_encoder(tokenizer_path), TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                ids = [None if pd.isna(i) else int(i) for i in part["doc_id"]]
                for own, encoded in zip(ids, stream.encoder.encode(part["text"].tolist())):
                    stream.add(own, encoded)
                if stream.tokens >= BLOCK:
                    stream.pack(final=False)
                    yield stream.taken()
        stream.pack(final=True)
        yield stream.taken()

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInPandas(packed, PIECES)
