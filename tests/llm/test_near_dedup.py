import random
from collections import defaultdict

from pyspark.sql import functions as F

from punctual.llm import graph, near_dedup, queries
from llm.data import SF


def shingles(text, width):
    w = (text or "").encode().lower().split()
    n = min(width, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset()


def brute(docs, width):
    """Smallest id reachable, over all pairs."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


def test_query_equals_brute_force(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = brute(docs, 4)
    for r in queries.op9_minhash_forest(spark, SF).collect():
        text = dict(docs)[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"]) == (len(shingles(text, 4)), want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def _edited(words, edits, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"n{rng.random()}"
    return " ".join(out)


def test_planted_groups_with_a_common_passage(frame):
    """Chains and clouds of near copies among texts that all share a passage; none is lost, none is invented."""
    rng = random.Random(5)
    common = " ".join(f"c{k}" for k in range(40))
    docs = []
    for group in range(30):
        base = [f"g{group}x{k}" for k in range(120)]
        for copy in range(rng.choice([1, 2, 3, 12])):
            docs.append((len(docs), common + " " + _edited(base, rng.choice([0, 1, 2, 3]) if copy else 0, rng)))
    got = near_dedup.near_duplicates(frame(docs), width=5).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(docs, 5)


def test_star_groups(frame):
    """Many edited copies that are linked only through their original; some of another text have no original."""
    rng = random.Random(11)
    docs = []
    for size, original in ((200, True), (2000, True), (60, False)):
        base = [f"s{size}x{k}" for k in range(200)]
        if original:
            docs.append((len(docs), " ".join(base)))
        docs += [(len(docs) + k, _edited(base, 5, rng)) for k in range(size)]
    got = near_dedup.near_duplicates(frame(docs), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(docs, 4)


def test_copies_edited_too_much_do_not_all_meet(frame, monkeypatch):
    """Copies on both sides of the threshold around one original: pairs looked at grow with the copies, not with their square."""
    rng, looked_at, possible = random.Random(23), [], near_dedup._possible

    def counted(rows, percent):
        looked_at.append(rows.count())
        return possible(rows, percent)

    monkeypatch.setattr(near_dedup, "_possible", counted)
    base = [f"b{k}" for k in range(150)]
    docs = [(0, " ".join(base))] + [(k, _edited(base, rng.randint(1, 9), rng)) for k in range(1, 601)]
    got = near_dedup.near_duplicates(frame(docs), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(docs, 4)
    assert looked_at[-1] < 20 * len(docs) and max(looked_at) < 40 * len(docs)


def test_odd_and_empty(odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)}
    assert {c for i in (6, 7, 9) for _, c in by[i]} == {6}
    assert by[8] == {(1, 8)} and (0, None) in by[None] and len(by[None]) == 2
    assert near_dedup.near_duplicates(empty).count() == 0


def test_one_of_each(odd, empty, frame):
    ids = sorted(str(r["doc_id"]) for r in near_dedup.one_of_each(odd).collect())
    assert ids == sorted(map(str, [1, 2, 3, 4, 5, 6, 8, 10, None]))
    assert near_dedup.one_of_each(empty).count() == 0
    assert near_dedup.one_of_each(odd).columns == odd.columns


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7), (300, 301), (301, 302), (300, 302)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bit_maps_rule_out_no_similar_pair(spark):
    """Sets at and next to the threshold, with few and with very many shingles."""
    import numpy as np

    rng = np.random.default_rng(3)
    maps, pairs, want = [], [], set()
    for n in (9, 45, 900, 9000):
        for apart in (0, n // 9 - 1, n // 9, n // 9 + 1, n // 2):
            both, x, y = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (n - apart, apart, apart))
            a, b = len(maps) + 1, len(maps)
            maps += [(node, n, bytearray(near_dedup.bit_map(np.concatenate([both, own])))) for node, own in ((b, x), (a, y))]
            pairs.append((a, b, 0.9))
            if 100 * (n - apart) >= 80 * (n + apart):
                want.add((a, b))
    pairs = spark.createDataFrame(pairs, "a long, b long, share double")
    got = near_dedup.fitting(pairs, spark.createDataFrame(maps, "node long, n_shingles long, bits binary"), 80).collect()
    kept = {(r["a"], r["b"]) for r in got}
    assert want <= kept and len(kept) < 20


KINDS = "token long, place int, node long, own long, n_shingles long, unseen long"


def test_shingles_too_late_for_a_pair_do_not_meet(spark):
    """Of 200 shingles a similar set of 200 may lack 22, so one that 60 nodes hold at place 30 makes no pair, and at place 10 it makes all."""
    for place, pairs in ((30, 0), (22, 1770), (10, 1770)):
        rows = spark.createDataFrame([(1, place, k, k, 200, 0) for k in range(60)], KINDS)
        assert near_dedup._meeting(near_dedup._celled(rows, 80), 80).count() == pairs


def test_meeting_loses_no_similar_pair(spark):
    """Random sets of many sizes, at and next to the threshold, in one order of their members."""
    rng, sets = random.Random(31), []
    for size in (1, 4, 5, 9, 10, 45, 100, 400):
        base = rng.sample(range(10**6), size)
        for lost in {0, size // 9, size // 9 + 1, size // 5, size // 5 + 1}:
            for new in {0, size // 9, size // 9 + 1, size // 4, size // 4 + 1}:
                sets.append(set(base[lost:]) | {rng.randrange(10**6, 10**9) for _ in range(new)})
        base = sorted(base)
        sets.append(set(base[size // 5 :]))  # what it lacks comes first in the order
    sets = [s for s in sets if s]
    rows = [
        (token, place, k, k, len(s), 0)
        for k, s in enumerate(sets) for place, token in enumerate(sorted(s)[: len(s) - -(-80 * len(s) // 100) + 1])
    ]
    met = near_dedup._meeting(near_dedup._celled(spark.createDataFrame(rows, KINDS), 80), 80)
    got = {(r["a"], r["b"]) for r in near_dedup._possible(near_dedup._rows_of(met, "x", "y", unseen=True), 80).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 80 * len(a | b)}
    assert want and want <= got


def test_beginnings_come_in_small_frames():
    import numpy as np
    import pandas as pd

    n = 1000
    batch = pd.DataFrame({"node": range(n), "own": range(n), "n_shingles": 200, "live": [np.arange(200)] * n})
    frames = list(near_dedup._beginnings(80)(iter([batch])))
    assert max(len(f) for f in frames) < 0.3 * sum(len(f) for f in frames)
