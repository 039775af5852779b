"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

1. **Nodes**: equal vectors are one node, so copies, however many, neither crowd the neighbour lists nor part the graph.
   A node keeps its ``most + 1`` smallest keys: no answer can need more of them.
2. **First neighbours**: ``TREES`` times the nodes are sorted by the signs of random projections (hyperplanes between
   pairs from a sample of ``SAMPLE`` nodes, cut at the sample's medians) and cut into blocks of at most ``LEAF`` nodes; within a
   block all distances are found in numpy.
3. **NN-descent**, ``ROUNDS`` times: each node takes up to ``TRIED`` of its neighbours and of the nodes that it is neighbour of, new ones first,
   and joins of the graph with the vectors bring those neighbours together: what was unknown to each other and is nearer than a
   node's last neighbour becomes an update. Lists hold ``WIDTH`` neighbours.
4. **Greedy search**: a query starts at its own node and at ``ENTRIES`` others. In each round the nearest
   ``EXPANDED`` of its best ``BEAM`` nodes that were not followed yet are followed along the graph, in both directions,
   until all of its best have been. The best ``CHECKED`` are ranked by exact distance of the original vectors.

All passes move bounded lists; hubs pass on at most ``TRIED`` (or ``WIDTH``, in the search) of their links. Groups for numpy are blocks or hash buckets of nodes of bounded
size. Inside, vectors are 32-bit, less the mean and divided by the largest entry; results use the original doubles.

Vectors that are null, empty, of another length than the most frequent one, all zero, or with null or non-finite entries take no part, as
queries or candidates. Queries are rows of the table; each row is answered, repeated ones too, and only the row itself is no
candidate of its own. Ties go to the smaller key, missing keys last and never as a query; fewer than ``most`` candidates are all returned while the graph is
connected, as it is where a block holds all nodes. Empty tables give no rows. Only key and vector are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from punctual.llm.common import stored
from punctual.llm.vectors import dense, dimension

TREES = 8
LEAF = 4000
SAMPLE = 4096
WIDTH = 20
ROUNDS = 2
TRIED = 10
ENTRIES = 16
BEAM = 256
EXPANDED = 64
CHECKED = 64
#: Nodes, and queries, whose lists are worked on together.
BUCKET = 1024
SEED = 13

_LISTS = "node long, nodes binary, distances binary"
_GRAPH = f"{_LISTS}, fresh binary, near binary, last float"


@dataclass(frozen=True)
class Index:
    """``nodes``: node, ``keys`` (smallest first), ``vector``, ``near`` (32-bit copy). ``graph``: the neighbour lists."""

    nodes: DataFrame
    graph: DataFrame
    count: int


def _participants(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``vector`` (doubles, no negative zeros) of the rows that take part."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    dim = dimension(rows, F.col("vector"))
    usable = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where((F.size("vector") == dim) & usable).select("key", F.transform("vector", lambda x: x + 0.0).alias("vector"))


def _nodes(rows: DataFrame, most: int) -> DataFrame:
    first = Window.partitionBy("vector").orderBy(F.asc_nulls_last("key"))
    few = rows.withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= most + 1)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("__place", "key"))), lambda e: e["key"])
    distinct = few.groupBy("vector").agg(keys.alias("keys"))
    return stored(distinct.select(F.monotonically_increasing_id().alias("node"), "keys", "vector"))


def _near(dim: int, mean: np.ndarray, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, values = dense(batch.column(2), dim)
            small = (values / scale - mean / scale).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in small], pa.binary())], names=["node", "keys", "vector", "near"])

    return reduce


def _matrix(column: pd.Series | pa.Array) -> np.ndarray:
    """Rows of 32-bit numbers; vectors of one length."""
    parts = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(parts), np.float32).reshape(len(parts), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two matrices, or of two stacks of them."""
    squares = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2))
    return np.maximum(squares, 0)


def _as_lists(owner: np.ndarray, node: np.ndarray, distance: np.ndarray) -> pd.DataFrame:
    """Pairs sorted by owner as one row of lists per owner."""
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(owner))
    nodes, distances = node.astype(np.int64).tobytes(), distance.astype(np.float32).tobytes()
    return pd.DataFrame(
        {
            "node": owner[starts],
            "nodes": [nodes[8 * s : 8 * e] for s, e in zip(starts, ends)],
            "distances": [distances[4 * s : 4 * e] for s, e in zip(starts, ends)],
        }
    )


def _as_pairs(lists: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(b) // 8 for b in lists["nodes"]], np.int64)
    return (
        np.repeat(lists["node"].to_numpy(np.int64), lengths),
        np.frombuffer(b"".join(lists["nodes"]), np.int64),
        np.frombuffer(b"".join(lists["distances"]), np.float32),
    )


def _nearest_pairs(owner: np.ndarray, node: np.ndarray, distance: np.ndarray, width: int) -> np.ndarray:
    """Places of each owner's nearest ``width`` distinct nodes, by owner and distance."""
    order = np.lexsort((node, distance, owner))
    pairs = np.stack([owner[order], node[order]], axis=1)
    # Of the same pair, found more than once, the first.
    by_pair = np.lexsort((np.arange(len(order)), pairs[:, 1], pairs[:, 0]))
    sorted_ = pairs[by_pair]
    again = np.zeros(len(order), bool)
    again[by_pair[1:]] = (sorted_[1:] == sorted_[:-1]).all(axis=1)
    order = order[~again]
    owners = owner[order]
    starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, np.int64)
    place = np.arange(len(owners)) - np.repeat(starts, np.diff(np.append(starts, len(owners))))
    return order[place < width]


def _bucket(node: str, count: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(max(1, math.ceil(count / BUCKET)))).cast("int")


# First neighbours


def _places(nodes: DataFrame, count: int) -> DataFrame:
    """``tree``, ``block`` and ``node``: the blocks of nodes that are compared with each other."""
    blocks = math.ceil(count / LEAF)
    if blocks == 1:
        return nodes.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("block"), "node")
    # SAMPLE vectors at most.
    sample = _matrix(nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("near").toPandas()["near"])
    rng = np.random.default_rng(SEED)
    bits = math.ceil(math.log2(blocks)) + 1
    planes = [sample[rng.integers(len(sample))] - sample[rng.integers(len(sample))] for _ in range(TREES * (bits + 1))]
    planes = np.array([p if p.any() else rng.standard_normal(len(p)) for p in planes], np.float32).T
    medians = np.median(sample @ planes, axis=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            n = batch.num_rows
            if n:
                along = (_matrix(batch.column(1)) @ planes).reshape(n, TREES, bits + 1)
                above = along[:, :, :bits] > medians.reshape(TREES, bits + 1)[:, :bits]
                yield pa.RecordBatch.from_pydict(
                    {
                        "tree": pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                        "code": pa.array((above @ powers).ravel()),
                        "along": pa.array(along[:, :, bits].astype(np.float64).ravel()),
                        "node": pa.array(np.repeat(batch.column(0).to_numpy(), TREES)),
                    }
                )

    keys = nodes.select("node", "near").mapInArrow(project, "tree int, code long, along double, node long")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "code", "along", "node"]
    # The place of a row: rows of the parts before, and its number in its own.
    own = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = stored(
        keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("tree", "node", F.spark_partition_id().alias("part"), own.alias("own"))
    )
    sizes = placed.groupBy("part").count().alias("sizes")
    before = F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per part of the sort.
    starts = sizes.select(F.col("part"), before.alias("start"))
    place = F.col("start") + F.col("own") - F.col("tree") * F.lit(count)
    return placed.join(F.broadcast(starts), "part").select("tree", F.floor(place * F.lit(blocks) / F.lit(count)).alias("block"), "node")


def _compare(block: pd.DataFrame) -> pd.DataFrame:
    """Nearest nodes of each node in a block."""
    node, near = block["node"].to_numpy(), _matrix(block["near"])
    width = min(WIDTH, len(node) - 1)
    owners, nodes, distances = [], [], []
    for at in range(0, len(node) if width else 0, 512):
        apart = _distances(near[at : at + 512], near)
        apart[np.arange(len(apart)), at + np.arange(len(apart))] = np.inf
        best = np.argpartition(apart, width - 1, axis=1)[:, :width]
        owners.append(np.repeat(node[at : at + 512], width))
        nodes.append(node[best].ravel())
        distances.append(np.take_along_axis(apart, best, axis=1).ravel())
    if not owners:
        return _as_lists(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return _as_lists(np.concatenate(owners), np.concatenate(nodes), np.concatenate(distances))


def _merge(graph: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """The graph's lists with further ones merged in; ``fresh`` marks what is new in a list."""
    known, new = _as_pairs(graph), _as_pairs(lists)
    owner, node, distance = (np.concatenate(x) for x in zip(known, new))
    fresh = np.concatenate([np.frombuffer(b"".join(graph["fresh"]), np.uint8), np.ones(len(new[0]), np.uint8)])
    # Known pairs come first, and sorting is stable, so a pair found again stays known.
    best = _nearest_pairs(owner, node, distance, WIDTH)
    out = _as_lists(owner[best], node[best], distance[best])
    marks, at = fresh[best].tobytes(), np.cumsum([0] + [len(b) // 8 for b in out["nodes"]])
    out["fresh"] = [marks[s:e] for s, e in zip(at, at[1:])]
    out["last"] = np.array([np.frombuffer(b, np.float32)[-1] if len(b) == 4 * WIDTH else np.inf for b in out["distances"]], np.float32)
    out = graph[["node", "near"]].merge(out, on="node", how="left")
    for name in ("nodes", "distances", "fresh"):
        out[name] = [b if isinstance(b, bytes) else b"" for b in out[name]]
    out["last"] = out["last"].fillna(np.inf).astype(np.float32)
    return out[["node", "nodes", "distances", "fresh", "near", "last"]]


def _merged(graph: DataFrame, lists: DataFrame, count: int) -> DataFrame:
    bucket = _bucket("node", count)
    return stored(graph.groupBy(bucket.alias("b")).cogroup(lists.groupBy(bucket.alias("b"))).applyInPandas(_merge, _GRAPH))


# NN-descent


def _chosen(batch: pd.DataFrame, turn: int) -> tuple[np.ndarray, ...]:
    """Owner, node, freshness and chance of all pairs, and the places of up to TRIED per owner: new ones first, else at random."""
    owner, node, _ = _as_pairs(batch)
    fresh = np.frombuffer(b"".join(batch["fresh"]), np.uint8)
    # The same choice also when a task is repeated.
    mixed = (owner.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (node.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(turn + 1)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    chance = (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53 - fresh
    order = np.lexsort((chance, owner))
    owners = owner[order]
    starts = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, np.int64)
    place = np.arange(len(owners)) - np.repeat(starts, np.diff(np.append(starts, len(owners))))
    return owner, node, fresh, chance, order[place < TRIED]


def _tried(turn: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Links (centre, node) in both directions."""

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, node, fresh, chance, chosen = _chosen(batch, turn)
            one, other, new, by = owner[chosen], node[chosen], fresh[chosen].astype(bool), chance[chosen]
            yield pd.DataFrame(
                {
                    "centre": np.concatenate([one, other]), "node": np.concatenate([other, one]), "fresh": np.concatenate([new, new]),
                    "back": np.repeat([False, True], len(one)), "chance": np.concatenate([by, by]),
                }
            )

    return tried


def _known(turn: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The graph with what was chosen in this turn no longer fresh."""

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, _, fresh, _, chosen = _chosen(batch, turn)
            left = fresh.copy()
            left[chosen] = 0
            at = np.cumsum([0] + [len(b) for b in batch["fresh"]])
            yield batch.assign(fresh=[left[s:e].tobytes() for s, e in zip(at, at[1:])])

    return known


def _introduce(links: pd.DataFrame) -> pd.DataFrame:
    """Pairs of nodes around the same centre that are nearer than the last neighbour of one of them."""
    links = links.sort_values("fresh", ascending=False, kind="stable").drop_duplicates(["centre", "node"]).sort_values("centre", kind="stable")
    centre, node, fresh = links["centre"].to_numpy(), links["node"].to_numpy(), links["fresh"].to_numpy()
    near, last = _matrix(links["near"]), links["last"].to_numpy()
    starts = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
    ends = np.append(starts[1:], len(centre))
    widest = int((ends - starts).max())
    # Around each centre a row of places, padded.
    at = starts[:, None] + np.arange(widest)
    filled = at < ends[:, None]
    at = np.where(filled, at, 0)
    owners, nodes, distances = [], [], []
    for k in range(0, len(at), 256):
        here, there = at[k : k + 256], filled[k : k + 256]
        apart = _distances(near[here], near[here])
        new = fresh[here][:, :, None] | fresh[here][:, None, :]
        other = node[here][:, :, None] != node[here][:, None, :]
        nearer = there[:, :, None] & there[:, None, :] & new & other & (apart < last[here][:, :, None])
        i, a, b = np.nonzero(nearer)
        owners.append(node[here[i, a]])
        nodes.append(node[here[i, b]])
        distances.append(apart[i, a, b])
    owner, other_node, distance = np.concatenate(owners), np.concatenate(nodes), np.concatenate(distances)
    best = _nearest_pairs(owner, other_node, distance, WIDTH)
    return _as_lists(owner[best], other_node[best], distance[best])


def _descend(graph: DataFrame, count: int, turn: int) -> DataFrame:
    links = graph.select("node", "nodes", "distances", "fresh").mapInPandas(
        _tried(turn), "centre long, node long, fresh boolean, back boolean, chance double"
    )
    few = Window.partitionBy("centre", "back").orderBy("chance", "node")
    links = links.withColumn("__place", F.row_number().over(few)).where(F.col("__place") <= TRIED)
    met = links.select("centre", "node", "fresh").join(graph.select("node", "near", "last"), "node")
    updates = met.groupBy(_bucket("centre", count).alias("b")).applyInPandas(_introduce, _LISTS)
    return _merged(graph.mapInPandas(_known(turn), _GRAPH), updates, count)


def build(vectors: DataFrame, key: str, vector: str, most: int = 10) -> Index:
    """The index of all rows; for answers of up to ``most`` rows."""
    return _build(stored(_participants(vectors, key, vector)), most)


def _build(rows: DataFrame, most: int) -> Index:
    nodes = _nodes(rows, most)
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest")).first()
    if not size["n"]:
        return Index(nodes.withColumn("near", F.lit(None).cast("binary")), rows.sparkSession.createDataFrame([], _GRAPH), 0)
    scale = 2 * size["largest"]
    means = nodes.select(F.posexplode("vector")).groupBy("pos").agg(F.sum(F.col("col") / F.lit(scale) / F.lit(float(size["n"]))).alias("mean"))
    found = {r["pos"]: r["mean"] for r in means.collect()}
    mean = np.array([found[k] for k in range(len(found))]) * scale
    nodes = stored(nodes.mapInArrow(_near(len(mean), mean, scale), "node long, keys array<long>, vector array<double>, near binary"))
    count, blank = size["n"], F.lit(b"").cast("binary")
    first = _places(nodes, count).join(nodes.select("node", "near"), "node").groupBy("tree", "block").applyInPandas(_compare, _LISTS)
    bare = nodes.select("node", blank.alias("nodes"), blank.alias("distances"), blank.alias("fresh"), "near", F.lit(float("inf")).cast("float").alias("last"))
    graph = _merged(bare, first, count)
    # Where one block held all nodes, nothing is left to find.
    for turn in range(ROUNDS if count > LEAF else 0):
        graph = _descend(graph, count, turn)
    return Index(nodes, graph, count)


# Greedy search

_STATE = "query long, near binary, nodes binary, distances binary, followed binary"


def _front(distances: np.ndarray, followed: np.ndarray) -> np.ndarray:
    """Places of the nodes to follow next."""
    best = np.argsort(distances, kind="stable")[:BEAM]
    return best[~followed[best]][:EXPANDED]


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        asked = [(q, np.frombuffer(n, np.int64)[_front(np.frombuffer(d, np.float32), np.frombuffer(f, bool))]) for q, n, d, f in zip(batch["query"], batch["nodes"], batch["distances"], batch["followed"])]
        yield pd.DataFrame(
            {"query": np.repeat([q for q, _ in asked], [len(a) for _, a in asked]).astype(np.int64), "node": np.concatenate([a for _, a in asked] or [np.zeros(0, np.int64)])}
        )


def _unseen(state: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
    """What was reached for the first time."""
    groups = dict(iter(reached.groupby("query")["nodes"]))
    queries, nodes = [], []
    for query, seen in zip(state["query"], state["nodes"]):
        if query in groups:
            new = np.setdiff1d(np.concatenate([np.asarray(n) for n in groups[query]]), np.frombuffer(seen, np.int64))
            queries.append(np.full(len(new), query))
            nodes.append(new)
    return pd.DataFrame({"query": np.concatenate(queries or [np.zeros(0, np.int64)]), "node": np.concatenate(nodes or [np.zeros(0, np.int64)])})


def _advance(state: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
    """Marks what was followed and takes the new nodes in."""
    groups = dict(iter(met.groupby("query")))
    out = []
    for query, near, nodes, distances, followed in state.itertuples(index=False):
        nodes, distances, followed = np.frombuffer(nodes, np.int64), np.frombuffer(distances, np.float32), np.frombuffer(followed, bool).copy()
        followed[_front(distances, followed)] = True
        if query in groups:
            new = groups[query]
            apart = _distances(np.frombuffer(near, np.float32)[None, :], _matrix(new["near"]))[0]
            nodes, distances = np.concatenate([nodes, new["node"].to_numpy(np.int64)]), np.concatenate([distances, apart])
            followed = np.concatenate([followed, np.zeros(len(new), bool)])
        out.append((query, near, nodes.tobytes(), distances.tobytes(), followed.tobytes()))
    return pd.DataFrame(out, columns=list(state.columns))


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        best = [np.frombuffer(n, np.int64)[np.argsort(np.frombuffer(d, np.float32), kind="stable")[:CHECKED]] for n, d in zip(batch["nodes"], batch["distances"])]
        yield pd.DataFrame({"query": np.repeat(batch["query"].to_numpy(np.int64), [len(b) for b in best]), "node": np.concatenate(best or [np.zeros(0, np.int64)])})


def _links(graph: DataFrame) -> DataFrame:
    """``node`` and the nodes linked with it: its neighbours, and the nearest WIDTH nodes that it is neighbour of."""

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, node, distance = _as_pairs(batch)
            yield pd.DataFrame(
                {"node": np.concatenate([owner, node]), "other": np.concatenate([node, owner]), "distance": np.tile(distance, 2), "back": np.repeat([False, True], len(owner))}
            )

    pairs = graph.select("node", "nodes", "distances").mapInPandas(both, "node long, other long, distance float, back boolean")
    few = Window.partitionBy("node", "back").orderBy("distance", "other")
    pairs = pairs.withColumn("__place", F.row_number().over(few)).where(F.col("__place") <= WIDTH)
    return stored(pairs.groupBy("node").agg(F.collect_set("other").alias("nodes")))


def _found(index: Index, asked: DataFrame) -> DataFrame:
    """``query`` and ``node``: the nodes found for each of ``asked`` (query node, near)."""
    links = _links(index.graph)
    entries = [r["node"] for r in index.nodes.select("node").orderBy(F.xxhash64("node")).limit(ENTRIES).collect()]
    starts = asked.select("query", F.explode(F.array_union(F.array("query"), F.array(*[F.lit(e).cast("long") for e in entries]))).alias("node"))
    blank = F.lit(b"").cast("binary")
    state = stored(asked.select("query", "near", blank.alias("nodes"), blank.alias("distances"), blank.alias("followed")))
    n = state.count()
    near = index.nodes.select("node", "near")
    new = starts
    while True:
        met = new.join(near, "node").groupBy(_bucket("query", n * 16).alias("b"))
        state = stored(state.groupBy(_bucket("query", n * 16).alias("b")).cogroup(met).applyInPandas(_advance, _STATE))
        front = stored(state.select("query", "nodes", "distances", "followed").mapInPandas(_ask, "query long, node long"))
        if front.isEmpty():
            break
        reached = front.join(links, "node").select("query", "nodes").groupBy(_bucket("query", n * 16).alias("b"))
        new = stored(state.groupBy(_bucket("query", n * 16).alias("b")).cogroup(reached).applyInPandas(_unseen, "query long, node long"))
    return state.mapInPandas(_best, "query long, node long")


def search(vectors: DataFrame, key: str, vector: str, is_query: Column, most: int = 10) -> DataFrame:
    """``query``, ``rank``, ``candidate`` and ``distance``: the ``most`` nearest rows found for each row for which ``is_query``, a condition
    on ``key``, holds."""
    rows = stored(_participants(vectors, key, vector))
    index = _build(rows, most)
    queries = rows.where(is_query & F.col("key").isNotNull())
    asked = stored(queries.select("vector").distinct().join(index.nodes, "vector").select(F.col("node").alias("query"), "vector", "near"))
    found = _found(index, asked.select("query", "near")) if index.count else rows.sparkSession.createDataFrame([], "query long, node long")
    # The queries' vectors come along from here on, so that they are joined once.
    pairs = found.join(asked.select("query", F.col("vector").alias("from")), "query").join(index.nodes.select("node", "keys", "vector"), "node")
    apart = F.sqrt(F.aggregate(F.zip_with("from", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    each = pairs.select("query", "from", apart.alias("distance"), F.explode("keys").alias("key"))
    order = Window.partitionBy("query").orderBy("distance", F.asc_nulls_last("key"))
    few = each.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most + 1)
    answers = few.groupBy("query").agg(
        F.first("from").alias("vector"), F.transform(F.array_sort(F.collect_list(F.struct("__place", "distance", "key"))), lambda e: F.struct(e["distance"], e["key"])).alias("best")
    )
    # Many rows may share a query vector; the join splits them.
    own = F.array_position(F.transform("best", lambda e: F.coalesce(e["key"] == F.col("asked"), F.lit(False))), True)
    answered = queries.withColumnRenamed("key", "asked").join(answers.drop("query"), "vector").select("asked", "best", own.alias("own"))
    others = F.slice(F.filter("best", lambda e, i: i + 1 != F.col("own")), 1, most)
    return answered.select(F.col("asked").alias("query"), F.posexplode(others).alias("place", "one")).select(
        "query", (F.col("place") + 1).alias("rank"), F.col("one.key").alias("candidate"), F.col("one.distance").alias("distance")
    )
