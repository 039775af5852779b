import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from punctual.llm import queries, ranked_search
from llm.data import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(docs, items, most=20):
    """(item, rank, doc, score) by the formulas, over (key, text) rows."""
    counts = [(k, plain_terms(t)) for k, t in docs]
    counts = [(k, c) for k, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, r in plain_terms(text).items() if t in c
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:most], 1)]
    return sorted(out, key=str)


@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_terms(text):
    assert {t.decode(): n for t, n in ranked_search.terms(text).items()} == plain_terms(text)


def test_terms_of_a_text_in_pieces(monkeypatch):
    text = "Some WORDS, über-all und 3x again; " * 50
    monkeypatch.setattr(ranked_search, "PIECE", 16)
    assert {t.decode(): n for t, n in ranked_search.terms(text).items()} == plain_terms(text)


@pytest.mark.parametrize("most", [1, 20, 500])
def test_tree_search_against_all_columns(most):
    rng = np.random.default_rng(5)
    found = {k: ranked_search.Found(most) for k in range(12)}
    asked = {k: (rng.choice(90, rng.integers(1, 30), replace=False), None) for k in found}
    asked = {k: (rows, rng.integers(0, 9, len(rows))) for k, (rows, _) in asked.items()}
    scores = {k: {} for k in found}
    for block in range(4):
        n = int(rng.integers(1, 300))
        keys = rng.permutation(np.arange(block * 1000, block * 1000 + n))
        cells = np.unique(rng.integers(0, [64, n], (2000, 2)), axis=0)
        # Few different values, so that scores tie.
        values = rng.integers(1, 4, len(cells)) * 1000
        built = ranked_search.K2Treap.build(cells[:, 0], cells[:, 1], values)
        tree = ranked_search.K2Treap.from_bytes(*built.to_bytes())
        assert all((a == b).all() for a, b in zip(built.maxima + built.children, tree.maxima + tree.children))
        grid = np.zeros((128, n), np.int64)
        grid[cells[:, 0], cells[:, 1]] = values
        for k, (rows, weights) in asked.items():
            tree.best(rows, weights, keys, most, found[k])
            scores[k] |= dict(zip(keys.tolist(), (weights @ grid[rows]).tolist()))
    for k in found:
        want = sorted((-s, key) for key, s in scores[k].items() if s > 0)[:most]
        assert [(-s, key) for s, key in zip(found[k].scores.tolist(), found[k].keys.tolist())] == want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    assert sorted(map(tuple, queries.op12_ranked_search(spark, SF).collect()), key=str) == brute(docs, items)


ITEMS = [(1, "Some TEXT that comes; more than once"), (2, None), (3, ""), (4, "?!"), (5, "nowhere-found"), (6, "short"), (6, "short"), (None, "w3x1 w3x2 w3x1")]


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item long, rank string, doc string")
    got = ranked_search.search(odd, "doc_id", "text", items, "item", "rank", most=3)
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS, most=3)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == 7


def test_slices_answer_the_same(spark, odd, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item long, text string")
    whole = sorted(map(tuple, ranked_search.search(odd, "doc_id", "text", items, "item", "text").collect()), key=str)
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 20)
    assert sorted(map(tuple, ranked_search.search(odd, "doc_id", "text", items, "item", "text").collect()), key=str) == whole


def test_many_equal_documents(spark):
    docs = [(k, "a copy of one text") for k in range(3000, 0, -1)] + [(0, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(1, "copy text")], "item long, text string")
    assert sorted(map(tuple, ranked_search.search(df, "doc_id", "text", items, "item", "text").collect()), key=str) == brute(docs, [(1, "copy text")])


def test_nothing_to_search(spark, empty, odd):
    items = spark.createDataFrame(ITEMS, "item long, text string")
    assert ranked_search.search(empty, "doc_id", "text", items, "item", "text").count() == 0
    assert ranked_search.search(odd, "doc_id", "text", items.limit(0), "item", "text").count() == 0
