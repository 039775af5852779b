import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from punctual.llm import packing, queries
from llm.data import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array(e.ids + [2], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, want):
    """Pieces cut each document's ids without loss; sequences have no gaps and at most 4096 tokens. Gives the sequences' lengths."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for key, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want[key])
            assert r["crc"] == zlib.crc32(want[key][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want[key])
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    return [sum(n for _, n in own) for own in sequences.values()]


def test_query_is_an_exact_round_trip_with_little_padding(spark, documents):
    docs = documents.collect()
    want = dict(zip([r["doc_id"] for r in docs], ids_of([r["text"] for r in docs])))
    lengths = check(queries.op2_packing(spark, SF).withColumnRenamed("ids_crc32", "crc").collect(), want)
    padding = sum(packing.LENGTH - n for n in lengths if n & (n - 1))
    assert padding < 0.01 * sum(lengths)


def test_plan_is_optimal():
    """Against all cuts, on small cases; the last cut lies within one window of the end."""
    rng = random.Random(1)
    for _ in range(200):
        length = rng.randrange(4, 12)
        places = np.cumsum([rng.randrange(1, length + 1) for _ in range(rng.randrange(1, 12))])
        penalties = np.array([rng.choice([0.0, 1.0, 5.0]) for _ in places])
        pos, best = [0, *places.tolist()], {0: 0.0}
        for j in range(1, len(pos)):
            best[j] = min(best[i] + length - (pos[j] - pos[i]) + penalties[j - 1] for i in range(j) if pos[j] - pos[i] <= length)
        ends = packing.plan_cuts(places, penalties, length)
        cost = sum(length - (b - a) + penalties[list(places).index(b)] for a, b in zip([0, *ends], ends))
        last = [k for k in best if k and pos[k] >= pos[-1] - length]
        assert cost == min(best[k] for k in last) and all(0 < b - a <= length for a, b in zip([0, *ends], ends))


def test_odd_and_empty(odd, empty, frame):
    pieces = packing.pack(odd, "doc_id", "text", PATH)
    assert pieces.groupBy().sum("length").first()[0] == sum(len(x) for x in ids_of([r["text"] for r in odd.collect()]))
    assert {r["ids"] for r in pieces.where("doc_id in (1, 2, 3)").collect()} == {b"\2\0\0\0"}
    assert packing.pack(empty, "doc_id", "text", PATH).count() == 0
    docs = [(1, "x" * 30000), (2, "<|endoftext|> a b c\x1cd İ ﬁ é"), (3, "word " * 9000), (4, "a. " * 5000)]
    got = packing.pack(frame(docs), "doc_id", "text", PATH).withColumn("crc", packing.F.crc32("ids"))
    check(got.collect(), dict(zip([i for i, _ in docs], ids_of([t for _, t in docs]))))


def test_ids_are_those_of_the_plain_call():
    """Special strings, letters that change length in lower case, combining signs, marks and odd blanks."""
    rng = random.Random(3)
    letters = "abcdeXYZ\u0130\u0131ßñÑéÜœŉ\u01c5ﬁÅ क़ड़אבמ漢字が가ㅏ①½Ⅷ²_'’`-.,;:!?…。<|>/\\#@$0123456789  \t\n\u2003\u00a0\u200b\u0307\u0327\x00😀"
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\u0130.", "S\u0130,", "don't", "'ll", "é.", "ñ;"]

    def text():
        out = []
        for _ in range(rng.randint(0, 14)):
            kind = rng.random()
            if kind < 0.25:
                out.append(rng.choice(parts))
            elif kind < 0.6:
                out.append("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCÑñéü\u0130", k=rng.randint(1, 9))) + rng.choice(["", ".", ",", "?;", "..."]))
            else:
                out.append("".join(rng.choices(letters, k=rng.randint(1, 8))))
            out.append(rng.choice(["", " ", " ", "\n", "\t "]))
        return "".join(out)

    texts = [text() for _ in range(20_000)]
    for got, want, t in zip(packing.PieceEncoder(PATH).encode(texts), ids_of(texts), texts):
        assert got.tolist() == want.tolist(), t
