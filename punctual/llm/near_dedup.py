r"""Near-duplicates by an LSH forest over MinHash signatures.

Each document becomes its set of word shingles; equal sets are one node. A node's signature has ``TREES``
orders of ``DEPTH`` hashes. Every order is a sorted list of all nodes, made by Spark's range partitioning (the
node's own key breaks ties, so no group is too large for a partition), and a node's candidates are its
``NEIGHBOURS`` predecessors that share at least the first hash: those with the longest common prefixes. The
depth of comparison so follows the region: a sparse one offers neighbours with short common prefixes, a dense
one only those with long ones. A pair that a partition border separates in one order meets in the others.

Candidates whose whole signatures agree in less than ``SCREEN`` of the hashes are dropped: at a similarity of
0.8 that is more than five standard deviations below. The others are confirmed on the full sets, in two
rounds: first each node's best candidate, then all pairs whose ends these links have not connected yet.
Before sets are fetched for a pair, here and below, two bit maps are compared: a bit that only one of them has
stands for at least one shingle that only one set has, so more such bits than a similar pair may have rule it out.
Connected components of confirmed links are the groups, so copies are never expanded into pairs.

What the forest leaves apart goes through an exact prefix filter, without caps: of two sets similar enough, the
rarest shingles, one more than may be missing, have one in common. Shingles found in one group only are
dropped by a count; in the others every node is first compared with the node of most links (the original of
many edited copies), then all pairs that are still in different groups, share a shingle of few nodes, and whose sizes
and places allow the similarity are confirmed. Rarity is taken from a sample: it orders the shingles, and any order is exact.
Nodes with a shingle of many nodes (copies edited too much to be linked, beside those that are) are ordered anew by exact
counts: shingles of one group come first, as no pair between groups shares them, and bands of sizes keep the beginnings
short. Such a copy's beginning holds little but its own edits, so it meets few others, however many copies there are.

Null texts and texts without words have the empty set and stand alone. Documents with the same id count as
one in ``component_id``; repeated rows get equal results; null ids are never the smallest; an empty table
gives an empty result; further columns are left out. Whole texts are used, whatever their length.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from punctual.llm.common import forget, stored_lean as stored
from punctual.llm.graph import components

TREES, DEPTH = 10, 6
NEIGHBOURS = 6
SCREEN = 0.52
#: Up to so many pairs (32 bytes each) are broadcast to the sets; more are joined by a shuffle.
BROADCAST_PAIRS = 100_000
#: Up to so many keys of texts (40 bytes each) are broadcast to the texts.
BROADCAST_KEYS = 1_000_000
#: Documents whose shingles are counted, and the count from which a shingle is not rare. They set cost, not results.
SAMPLE, COMMON = 16_000, 3
#: Rounds against the node of most links before all pairs that are left.
HUB_ROUNDS = 2
#: Nodes that share a shingle meet in pairs up to so many; those of more crowded shingles are ordered anew. It sets cost, not results.
FEW = 64
#: Bits of a node's map, as a power of two. They set cost, not results.
MAP_BITS = 12

_SEEDS = np.random.default_rng(20240229).integers(1, 2**32, (2, TREES * DEPTH, 1), dtype=np.uint32)
_TIMES, _PLUS = _SEEDS[0] | np.uint32(1), _SEEDS[1]

#: First sizes of bands, each a sixteenth wider than the one before.
_BANDS = [1]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(_BANDS[-1] + max(1, _BANDS[-1] >> 4))


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; words are lower-cased in A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: ASCII case and blanks only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = _mix(total + h[k : len(h) - width + 1 + k])
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def signature(items: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    halves = (items >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(_TIMES), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(halves), 1024):
        np.minimum(low, (halves[at : at + 1024] * _TIMES + _PLUS).min(axis=1), out=low)
    return low.astype(">u4")


def bit_map(items: np.ndarray) -> np.ndarray:
    """A bit for each shingle, told by the last bits of its hash."""
    bits = np.zeros(1 << MAP_BITS, np.bool_)
    bits[(items & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def _sample_rows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"token": shingles(text, width, hashes).view(np.int64)})

    return run


def common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that are not rare in a sample of the texts, and their counts."""
    share = SAMPLE / max(rows.count(), 1)
    some = rows.select("text") if share >= 1 else rows.select("text").sample(share, seed=1)
    counts = some.mapInPandas(_sample_rows(width), "token long").groupBy("token").count().where(F.col("count") >= COMMON).toPandas()
    tokens = counts["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], counts["count"].to_numpy(np.int64)[order]


def rarest(items: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set's first members by rarity, then hash: one more than a set similar enough may lack."""
    known, counts = common
    often = np.zeros(len(items), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, items), len(known) - 1)
        often = np.where(known[at] == items, counts[at], 0)
    # The set is sorted by hash already, and a stable order of small numbers takes linear time.
    order = np.argsort(np.minimum(often, 2**16 - 1).astype(np.uint16), kind="stable")
    return items[order[: len(items) + percent * len(items) // -100 + 1]]


def _signatures(width: int, percent: int, common: tuple[np.ndarray, np.ndarray]):
    def of(text: str, hashes: dict) -> tuple:
        own = shingles(text, width, hashes)
        if not len(own):
            return 0, None, None, None, None
        node = xxhash.xxh3_128_digest(own.tobytes())
        return len(own), node, signature(own).tobytes(), bit_map(own).tobytes(), rarest(own, percent, common).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                # Copies side by side are cut once.
                known = {text: of(text, hashes) for text in part["text"].unique()}
                out = [known[text] for text in part["text"]]
                frame = pd.DataFrame(out, columns=["n_shingles", "node", "signature", "bits", "rare"])
                yield part[["doc_id", "text_key"]].reset_index(drop=True).join(frame)

    return run


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of near rows in a sorted partition."""
    size = 4 * TREES * DEPTH
    kept = None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        fresh = 0 if kept is None else len(kept)
        tree = rows["tree"].to_numpy()
        full = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(rows), size // 4, 4)
        first = np.frombuffer(b"".join(k[:4] for k in rows["prefix"]), ">u4")
        node = rows["node"].to_numpy()
        for back in range(1, min(NEIGHBOURS, len(rows) - 1) + 1):
            later = np.arange(max(back, fresh), len(rows))
            earlier = later - back
            same = (tree[later] == tree[earlier]) & (first[later] == first[earlier])
            later, earlier = later[same], earlier[same]
            share = (full[later] == full[earlier]).all(axis=2).mean(axis=1)
            close = share >= SCREEN
            a, b = node[later[close]], node[earlier[close]]
            if len(a):
                yield pd.DataFrame(
                    {"a": [max(x, y) for x, y in zip(a, b)], "b": [min(x, y) for x, y in zip(a, b)], "share": share[close]}
                )
        kept = rows.iloc[-NEIGHBOURS:].reset_index(drop=True)


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a > b) of ``nodes`` (node, signature) near each other in an order, with the agreeing share of hashes."""
    width = 4 * DEPTH
    orders = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring(F.col("signature"), t * width + 1, F.lit(width)).alias("prefix")),
    )
    forest = nodes.select("node", "signature", F.inline(orders))
    ordered = forest.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
    near = ordered.select("tree", "prefix", "node", "signature").mapInPandas(_neighbours, "a long, b long, share double")
    return near.groupBy("a", "b").agg(F.max("share").alias("share"))


def _set_rows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            own = [shingles(text, width, hashes) for text in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "items": [x.tobytes() for x in own]})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["items_a"], batch["items_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[good, ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    first = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    second = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    return stored(pairs.join(first, "a").join(second, "b").select("a", "b", "items_a", "items_b").mapInPandas(_confirm(percent), "a long, b long"))


def _fits(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint64).reshape(len(batch), -1) for c in ("bits_a", "bits_b"))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            sizes = (batch["size_a"] + batch["size_b"]).to_numpy()
            yield batch.loc[apart * (100 + percent) <= sizes * (100 - percent), ["a", "b", "share"]]

    return run


def fitting(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, share) that the bit maps of their nodes (node, n_shingles, bits) do not rule out.

    Two similar sets differ in at most (100 - percent) / (100 + percent) of the sum of their sizes.
    """
    of = lambda end: maps.select(F.col("node").alias(end), F.col("n_shingles").alias(f"size_{end}"), F.col("bits").alias(f"bits_{end}"))
    return stored(pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(_fits(percent), "a long, b long, share double"))


def _best_of_each(pairs: DataFrame) -> DataFrame:
    """Each node's pair with the largest share."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"), "share", "a", "b")
    best = ends.groupBy("node").agg(F.max(F.struct("share", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def links(sets_of_needed, pairs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that connect all nodes which confirmed pairs connect."""
    sets = sets_of_needed(stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    best = stored(_best_of_each(pairs))
    first = confirmed(best, sets, percent)
    group = stored(components(first))
    label = lambda end: group.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group"))
    rest = stored(
        pairs.join(best, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
        .where(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b")
    )
    more = confirmed(rest, sets, percent)
    forget(sets)
    return first.unionByName(more)


def _postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            tokens = [np.frombuffer(x, np.int64) for x in part["rare"]]
            sizes = [len(t) for t in tokens]
            held = {c: np.repeat(part[c].to_numpy(), sizes) for c in ("node", "n_shingles")}
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            yield pd.DataFrame({"token": np.concatenate(tokens), "place": place, **held})


def _groups(found: DataFrame) -> DataFrame:
    return stored(components(found))


def _numbered(rows: DataFrame, group: DataFrame) -> DataFrame:
    """``rows`` with the group of their node."""
    own = group.select("node", F.col("component").alias("own"))
    return rows.join(own, "node", "left").withColumn("own", F.coalesce("own", "node"))


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of (a, b, token's place and size of set in each) that can be similar enough.

    Up to the last shingle common to both beginnings, those counted are common, and of those not looked at no more than
    either has (unseen); after it, no more than what follows.
    """
    sums = rows.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("both"), F.max("place_a").alias("place_a"), F.max("place_b").alias("place_b"),
        F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.max(F.least("unseen_a", "unseen_b")).alias("unseen"),
    )
    most = F.col("both") + F.col("unseen") + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) - 1
    return sums.where(most * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent).select("a", "b")


def _spread(rows: DataFrame, *more: Column, by: tuple[str, ...] = ("token",)) -> DataFrame:
    """The tokens that nodes of two groups hold."""
    return rows.groupBy(*by).agg(F.min("own").alias("low_own"), F.max("own").alias("high_own"), *more).where(
        F.col("low_own") != F.col("high_own")).drop("low_own", "high_own")


def _rows_of(pairs: DataFrame, x: str, y: str, unseen: bool = False) -> DataFrame:
    """The rows ``x`` and ``y`` of a join as ``_possible`` takes them."""
    names = [("node", "{}"), ("place", "place_{}"), ("n_shingles", "size_{}")]
    ends = ((x, "a"), (y, "b"))
    return pairs.select(
        *[F.col(f"{side}.{name}").alias(to.format(end)) for side, end in ends for name, to in names],
        *[(F.col(f"{side}.unseen") if unseen else F.lit(0)).alias(f"unseen_{end}") for side, end in ends],
    )


def _tokens(of: str, holder: str):
    """A row for each member of the sets in ``of``, with ``holder``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                tokens = [np.frombuffer(x, np.int64) for x in part[of]]
                yield pd.DataFrame({"token": np.concatenate(tokens), holder: np.repeat(part[holder].to_numpy(), [len(t) for t in tokens])})

    return run


def _most_apart(size: int, other: int, percent: int) -> int:
    """How many members of a set of ``size`` a similar one of ``other`` members or more may lack."""
    return size - -(-percent * (size + other) // (100 + percent))


def _beginnings(percent: int):
    """For each band of possible partners' sizes, what of a node's ordered set must have a shingle in common with a similar one there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # A node has a row for each band and shingle of its beginning, so a whole batch of them would be large.
            for at in range(0, len(batch), 256):
                part, out = batch.iloc[at : at + 256], []
                for node, own, size, live in zip(part["node"], part["own"], part["n_shingles"], part["live"]):
                    band, alone = bisect_right(_BANDS, size) - 1, size - len(live)
                    least = -(-size * percent // 100)
                    for other in range(bisect_right(_BANDS, least) - 1, bisect_right(_BANDS, size * 100 // percent)):
                        beginning = live[: max(0, _most_apart(size, max(least, _BANDS[other]), percent) + 1 - alone)]
                        if len(beginning):
                            place = np.arange(alone, alone + len(beginning), dtype=np.int32)
                            out.append((beginning, place, min(band, other), max(band, other), band, node, own, size))
                if out:
                    lengths = [len(row[0]) for row in out]
                    frame = {"token": np.concatenate([row[0] for row in out]), "place": np.concatenate([row[1] for row in out])}
                    for k, name in enumerate(["low", "high", "band", "node", "own", "n_shingles"], 2):
                        frame[name] = np.repeat([row[k] for row in out], lengths)
                    yield pd.DataFrame(frame)

    return run


def crowded_pairs(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``nodes`` (node, own, n_shingles) of different groups that can be similar, by an exact order of their ``sets`` (node, items).

    Shingles held in one group come first, the others by falling rarity among these nodes.
    """
    owned = sets.join(nodes.select("node", "own"), "node").select("items", "own").mapInPandas(_tokens("items", "own"), "token long, own long")
    shared = stored(_spread(owned, F.count(F.lit(1)).alias("holders")))
    held = sets.select("items", "node").mapInPandas(_tokens("items", "node"), "token long, node long")
    live = held.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("holders", "token"))).getField("token").alias("live"))
    kinds = "token long, place int, low int, high int, band int, node long, own long, n_shingles long"
    rows = stored(live.join(nodes, "node").select("node", "own", "n_shingles", "live").mapInPandas(_beginnings(percent), kinds))
    forget(shared)
    key = ("token", "low", "high")
    rows = stored(rows.join(_spread(rows, by=key), list(key), "left_semi"))
    x, y = F.col("x.n_shingles"), F.col("y.n_shingles")
    needed = F.ceil((x + y) * percent / (100 + percent))
    near = rows.where("band = low").alias("x").join(
        rows.where("band = high").alias("y"),
        (F.col("x.token") == F.col("y.token")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
        & (F.col("x.own") != F.col("y.own")) & ((F.col("x.low") != F.col("x.high")) | (F.col("x.node") > F.col("y.node")))
        & (F.col("x.place") <= x - needed) & (F.col("y.place") <= y - needed),
    )
    pairs = stored(_possible(_rows_of(near, "x", "y"), percent))
    forget(rows)
    return pairs


def _lacking(own: Column, other: Column, percent: int) -> Column:
    """How many members of a set of ``own`` a similar one of ``other`` members may lack; more come after the first common one in any order."""
    return own - F.ceil((own + other) * percent / (100 + percent))


def _celled(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with band and cell, without those too late in their set for any partner in the cell.

    Similar sets are of one band of sizes or of two next to each other, so each cell of two bands is looked at by itself.
    """
    ratio, size = 100.01 / percent, F.col("n_shingles")
    rows = rows.withColumn("band", F.floor(F.log(size) / math.log(ratio))).withColumn("cell", F.explode(F.array("band", F.col("band") + 1)))
    lowest = F.when(F.col("band") == F.col("cell"), F.col("cell") - 1).otherwise(F.col("cell"))
    # One less than the band's first size, as powers are rounded.
    partner = F.greatest(F.ceil(size * percent / 100), F.floor(F.pow(F.lit(ratio), lowest)) - 1)
    return rows.where(F.col("place") <= _lacking(size, partner, percent))


def _meeting(few: DataFrame, percent: int) -> DataFrame:
    """Rows ``x`` and ``y`` of different groups with a token and cell in common, none of them too late for the sizes.

    The first shingle common to two similar sets has in each no more before it than the other may lack. Rows left out
    so are the last of a pair, and ``_possible`` allows for what follows.
    """
    x, y = F.col("x.n_shingles"), F.col("y.n_shingles")
    return few.alias("x").join(
        few.alias("y"),
        (F.col("x.token") == F.col("y.token")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.node") > F.col("y.node"))
        & (F.col("x.own") != F.col("y.own")) & (F.greatest("x.band", "y.band") == F.col("x.cell"))
        & (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
        & (F.col("x.place") <= _lacking(x, y, percent)) & (F.col("y.place") <= _lacking(y, x, percent)),
    )


def missing_links(sets_of_needed, nodes: DataFrame, maps: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Components of ``found`` and of further links, so that no similar pair of ``nodes`` (node, n_shingles, rare) is parted.

    ``nodes`` is deleted once its shingles are dealt out.
    """
    group = _groups(found)
    numbered = stored(_numbered(nodes.select("node", "n_shingles", "rare"), group))
    forget(nodes)
    shared = stored(_spread(numbered.select("rare", "own").mapInPandas(_tokens("rare", "own"), "token long, own long")))
    postings = numbered.select("node", "n_shingles", "rare").mapInPandas(_postings, "token long, place int, node long, n_shingles long")
    rows = stored(postings.join(shared, "token", "left_semi"))
    forget(shared)
    forget(numbered)
    likely = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent

    def confirm(pairs: DataFrame, read: DataFrame) -> DataFrame | None:
        """Links among the pairs; ``read``, of which these are made, is deleted before sets are fetched."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = stored(pairs.withColumn("share", F.lit(None).cast("double")))
        forget(read)
        pairs = fitting(pairs, maps, percent)
        if pairs.isEmpty():
            return None
        sets = sets_of_needed(stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        good = confirmed(pairs.select("a", "b"), sets, percent)
        forget(sets)
        return None if good.isEmpty() else good

    for _ in range(HUB_ROUNDS):
        degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        here = _numbered(rows, group).join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        here = stored(here)
        hubs = _spread(here, F.max(F.struct("degree", "node", "n_shingles", "own", "place")).alias("hub"))
        near = here.alias("x").join(hubs, "token").where((F.col("own") != F.col("hub.own")) & likely(F.col("x.n_shingles"), F.col("hub.n_shingles")))
        good = confirm(_possible(_rows_of(near, "x", "hub"), percent), here)
        if good is None:
            break
        found = stored(found.unionByName(good))
        group = _groups(found)
    here = _celled(_numbered(rows, group), percent)
    here = stored(here.join(_spread(here, F.count(F.lit(1)).alias("holders"), by=("token", "cell")), ["token", "cell"]))
    forget(rows)
    crowded = here.where(F.col("holders") > FEW).groupBy("node").agg(F.count_distinct("token").alias("unseen"), F.first("n_shingles").alias("n_shingles"))
    crowded = stored(crowded)
    few = here.where(F.col("holders") <= FEW).join(crowded.select("node", "unseen"), "node", "left").withColumn("unseen", F.coalesce("unseen", F.lit(0)))
    near = _meeting(few, percent)
    good = confirm(_possible(_rows_of(near, "x", "y", unseen=True), percent), here)
    if good is not None:
        found = stored(found.unionByName(good))
        group = _groups(found)
    if crowded.isEmpty():
        return group
    crowded = stored(_numbered(crowded, group).select("node", "own", "n_shingles"))
    sets = sets_of_needed(crowded.select("node"))
    pairs = crowded_pairs(sets, crowded, percent)
    forget(sets)
    good = confirm(pairs, pairs)
    return group if good is None else _groups(found.unionByName(good))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (MD5 of the text), n_shingles, node (null without words), group, component_id.

    Rows of one ``group`` are near-duplicates; ``component_id`` is the group's smallest doc_id.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", text_key(F.col("text")))
    id_type = dict(rows.dtypes)["doc_id"]
    signed = stored(
        rows.mapInPandas(
            _signatures(width, percent, common_shingles(rows, width)),
            f"doc_id {id_type}, text_key binary, n_shingles long, node binary, signature binary, bits binary, rare binary",
        )
    )
    nodes = signed.where("node is not null").groupBy(F.col("node").alias("digest")).agg(
        F.first("signature").alias("signature"), F.min("text_key").alias("text_key"), F.min("doc_id").alias("low"),
        F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"), F.first("rare").alias("rare"),
    )
    # From here on a node is a number: links and postings carry eight bytes for it.
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    known = stored(signed.select("doc_id", "text_key", "n_shingles", F.col("node").alias("digest")))
    forget(signed)
    # Few columns are needed to the end; the whole rows go earlier.
    heads = stored(nodes.select("node", "digest", "text_key", "low", "n_shingles", "bits"))
    pairs = fitting(stored(candidates(nodes.select("node", "signature"))), heads, percent)

    def sets_of(needed: DataFrame) -> DataFrame:
        """Full sets of the needed nodes: one text of each is shuffled, and only its set is kept."""
        wanted = heads.select("node", "text_key").join(needed, "node").select("text_key", "node")
        wanted = stored(wanted)
        # The keys of few texts go to where the texts are read, so that others are not shuffled.
        keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
        texts = rows.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
        return stored(texts.join(wanted, "text_key").select("node", "text").mapInPandas(_set_rows(width), "node long, items binary"))

    group = missing_links(sets_of, nodes, heads, stored(links(sets_of, pairs, percent)), percent)
    placed = heads.select("node", "digest", "low").join(group, "node", "left").withColumn("group", F.coalesce("component", "node"))
    placed = stored(placed.select("node", "digest", "low", "group"))
    lowest = placed.groupBy("group").agg(F.min("low").alias("component_low"))
    labels = stored(placed.join(lowest, "group").select("digest", "node", "group", "component_low"))
    forget(heads)
    return (
        known.join(labels, "digest", "left").drop("digest")
        .withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_low")))
        .drop("component_low")
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id, then text hash. Rows equal in both are one."""
    found = near_duplicates(docs, doc_id, text, width, percent)
    key = lambda i, t: F.md5(F.concat(F.coalesce(i.cast("string"), F.lit("-")).cast("binary"), t))
    alone = F.coalesce(F.col("group").cast("string").cast("binary"), F.col("text_key"))
    first = found.groupBy(alone.alias("g"), F.col("group").isNull().alias("empty"), F.when(F.col("group").isNull(), F.col("doc_id")).alias("i")).agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), "text_key")).alias("first")
    )
    stay = stored(first.select(key(F.col("first.doc_id"), F.col("first.text_key")).alias("key")))
    held = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), key(F.col(f"`{doc_id}`"), text_key(F.col(f"`{text}`"))).alias("key"))
    return held.join(stay, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
