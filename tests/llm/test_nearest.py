import math

import numpy as np
import pytest

from punctual.llm import nearest, queries
from llm.data import SF

F = nearest.F


def brute(rows, asked, most=10):
    """(query, rank, candidate, distance) over (key, vector) rows; ``asked`` says which keys are queries."""
    out = []
    for at, (key, vector) in enumerate(rows):
        if key is not None and asked(key):
            near = [(math.dist(vector, v), k is None, k or 0, k) for i, (k, v) in enumerate(rows) if i != at]
            out += [(key, rank, n[3], n[0]) for rank, n in enumerate(sorted(near, key=lambda n: n[:3])[:most], 1)]
    return out


def same(got, want):
    key = lambda r: (r[0], r[1], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_whole_table(spark):
    table = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(queries.op13_nearest_neighbours(spark, SF).collect(), brute(table, lambda k: k % 100 == 0))


def test_graph_of_many_blocks(spark, monkeypatch):
    """Blocks of 150 of 2,000 nodes: the descent improves the graph, the search finds nine of ten."""
    monkeypatch.setattr(nearest, "LEAF", 150)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 24)) + 3 * rng.integers(0, 2, (2000, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    true = {(q, c) for q, _, c, _ in brute(rows, lambda k: k % 20 == 0)}
    got = nearest.search(df, "vec_id", "embedding", F.col("key") % 20 == 0).collect()
    assert len(got) == 1000 and len(true & {(r["query"], r["candidate"]) for r in got}) >= 900
    for r in got:
        assert math.isclose(r["distance"], math.dist(x[r["query"]], x[r["candidate"]]), rel_tol=1e-12)

    def hits(rounds):
        monkeypatch.setattr(nearest, "ROUNDS", rounds)
        graph = nearest.build(df, "vec_id", "embedding")
        keys = {r["node"]: r["keys"][0] for r in graph.nodes.collect()}
        lists = [(keys[r["node"]], [keys[n] for n in np.frombuffer(r["nodes"], np.int64)[:10]]) for r in graph.graph.collect()]
        assert all(len(set(c)) == len(c) and q not in c for q, c in lists) and len(lists) == 2000
        return sum((q, c) in true for q, cs in lists for c in cs)

    assert hits(2) > hits(0)


def test_every_place_in_one_block_of_each_tree(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 64)
    rng = np.random.default_rng(7)
    nodes = spark.createDataFrame([(k, rng.normal(size=5).astype(np.float32).tobytes()) for k in range(1000)], "node long, near binary")
    places = nearest._places(nodes, 1000).toPandas()
    assert len(places) == 1000 * nearest.TREES and places.groupby("tree")["node"].nunique().eq(1000).all()
    sizes = places.groupby(["tree", "block"]).size()
    assert sizes.max() <= 64 and sizes.min() >= 62


@pytest.mark.parametrize("scale", [1.0, 1e-100, 1e100])
def test_odd_rows(spark, scale):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(6)
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 1.0, 1.0]), (105, [1.0]), (106, [0.0, -0.0, 0.0])]
    good = [(k, (rng.normal(size=3) * scale).tolist()) for k in range(40)]
    good += [(200 + k, good[0][1]) for k in range(30)] + [good[0], good[5], (None, good[7][1]), (61, [-0.0, scale, 0.0]), (60, [0.0, scale, -0.0])]
    schema = "query long, node array<double>, keys string, rank int, key int"
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in bad + good], schema).repartition(3)
    same(nearest.search(df, "query", "node", F.col("key") % 5 == 0).collect(), brute(good, lambda k: k % 5 == 0))


def test_few_and_no_rows(spark):
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    every = F.col("key") % 100 == 0
    same(nearest.search(df, "vec_id", "embedding", every).collect(), brute(few, lambda k: k % 100 == 0))
    assert nearest.search(df.limit(1), "vec_id", "embedding", every).count() == 0
    assert nearest.search(df.where("vec_id < 0"), "vec_id", "embedding", every).count() == 0
