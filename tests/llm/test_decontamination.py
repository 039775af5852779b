import random
import re

import pytest
from pyspark.sql import functions as F

from punctual.llm import decontamination, queries
from llm.data import SF


def plain(text):
    return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "


def test_query_finds_all_whole_items_and_no_others(spark, documents):
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(r["doc_id"], i) for r in documents.collect() for i, t in items if t in plain(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, SF).collect()}
    assert got == want


def scores(index, terms):
    """BM25 of every unit, term by term."""
    total = {}
    for t in terms:
        for unit, weight in zip(index.units[t], index.weights[t]):
            total[unit] = total.get(unit, 0.0) + weight
    return total


def test_wand_gives_what_full_scoring_gives():
    rng = random.Random(2)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 90))), "") for k in range(80)]
    index = decontamination.build_index(items, {}, 40.0)
    for threshold in (0.3, 0.5, 0.9):
        for _ in range(40):
            query = sorted({index.terms[w] for w in rng.choices(vocabulary, k=30) if w in index.terms})
            want = {u: s for u, s in scores(index, query).items() if s >= threshold}
            got = {}
            for block in range(index.bounds.shape[1]):
                got |= dict(decontamination.wand(index, query, block, threshold))
            edge = {u for u, s in (want | got).items() if abs(s - threshold) < 1e-9}  # there the order of addition decides
            assert {u: s for u, s in got.items() if u not in edge} == pytest.approx({u: s for u, s in want.items() if u not in edge})


@pytest.fixture
def bank(spark):
    items = [
        (1, "What is the capital of the land of the seven rivers and hills", "It is the old town of Avela"),
        (2, "long " + " ".join(f"q{k}" for k in range(150)), "answer of many words here"),
        (3, None, None), (4, "", ""), (None, "an item without id but with words enough", "yes it has"),
        (1, "What is the capital of the land of the seven rivers and hills", "It is the old town of Avela"),
    ]
    return spark.createDataFrame(items, "item_id long, q string, a string")


def leaks(docs, bank):
    return {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, "doc_id", "text", bank, "item_id", F.col("q"), F.col("a")).collect()}


def test_question_and_answer(frame, bank, monkeypatch):
    pad = " ".join(f"pad{k}" for k in range(300))
    q, a = "what is the CAPITAL of the land, of the seven rivers and hills?", "It is the old town of Avela."
    docs = frame(
        [(1, f"{pad} {q} {a} {pad}"), (2, f"{pad} {q} {pad}"), (3, f"{pad} {a} {pad}"), (4, pad), (5, q + a),
         (6, f"{pad} long {' '.join(f'q{k}' for k in range(150))} answer of many words here"), (7, "an item without id but with words enough yes it has"),
         (None, f"{q} {a}")]
    )
    want = {(1, 1), (5, 1), (6, 2), (7, None), (None, 1)}
    assert leaks(docs, bank) == want
    monkeypatch.setattr(decontamination, "SHARD_UNITS", 2)
    assert leaks(docs, bank) == want


def test_odd_and_empty(odd, empty, bank):
    assert leaks(odd, bank) == set() and leaks(empty, bank) == set() and leaks(odd, bank.limit(0)) == set()


def test_last_sentence(spark):
    rows = [("One is. Two is! Three.",), ("only one",), (None,), ("",), ("a\nb",), ("x.",)]
    q, a = decontamination.last_sentence(F.col("t"))
    assert [tuple(r) for r in spark.createDataFrame(rows, "t string").select(q, a).collect()] == [
        ("One is. Two is!", "Three."), ("only one", ""), ("", ""), ("", ""), ("a\n", "b"), ("x.", "")
    ]
