"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records into buckets that fit into memory, by seeded hashes: the shard from the key
alone (highest random weight, so one more shard takes records only into itself), the bucket inside the
shard from all columns. Pass 2 applies Fisher-Yates (Spark's ``shuffle``) to each bucket and writes it.
A record's slot is its place in its bucket plus the records of the shard's earlier buckets.

Nothing but one bucket is ever held together, and the number of buckets follows the bytes. Records with one
key but different content spread over the buckets of their shard. So do records that are equal in all columns, if
together they are more than a bucket: a first count finds them, and a hash of their position in the input
deals them out. As they are equal, the result does not depend on these positions beyond the lengths of buckets.

Null keys form one key; null or empty texts are ordinary records; records that are equal in all columns are
kept, each with its own slot; an empty table gives an empty result; further columns travel along (the names
in ``ADDED`` are replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from punctual.llm.common import stored

#: Up to so many buckets (24 bytes each) the table of their first slots is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BUCKETS = 200_000
#: What a record takes in a bucket besides its ``size``.
ROW_BYTES = 64
ADDED = ["shard", "grown_shard", "bucket", "slot"]


def highest_weight(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is largest."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*weights)["s"] if shards > 1 else F.lit(0)


def large_groups(records: DataFrame, size: Column, bucket_bytes: int) -> DataFrame:
    """``content`` (hash) of records that are equal in all columns and more than one bucket, with the ``parts`` to deal them into."""
    content = F.xxhash64(*[F.col(f"`{c}`") for c in records.columns])
    weight = F.sum(size.cast("long") + ROW_BYTES)
    found = records.groupBy(content.alias("content")).agg(weight.alias("weight")).where(F.col("weight") > bucket_bytes)
    return found.select("content", F.ceil(F.col("weight") / bucket_bytes).alias("parts"))


def scatter(records: DataFrame, key: str, shards: int, buckets: int, seed: int, large: DataFrame | None = None) -> DataFrame:
    """Pass 1: shard, shard after growth by one, and bucket of every ``record``."""
    own, content = F.col(f"`{key}`"), [F.col(f"`{c}`") for c in records.columns]
    mixed = F.xxhash64(F.lit(seed + 1), *content)
    rows = records.select(
        F.struct(*content).alias("record"), own.alias("own"), mixed.alias("mixed"),
        *([F.xxhash64(*content).alias("content"), F.monotonically_increasing_id().alias("at")] if large is not None else []),
    )
    mixed = F.col("mixed")
    if large is not None:
        rows = rows.join(large, "content", "left")
        part = F.pmod(F.xxhash64(F.lit(seed + 3), F.col("at")), F.col("parts"))
        mixed = F.when(F.col("parts").isNull(), mixed).otherwise(F.xxhash64(mixed, part))
    own = F.col("own")
    return rows.select(
        "record",
        highest_weight(own, shards, seed).alias("shard"),
        highest_weight(own, shards + 1, seed).alias("grown_shard"),
        F.pmod(mixed, F.lit(buckets)).cast("int").alias("bucket"),
    )


def shuffle_buckets(scattered: DataFrame, seed: int) -> DataFrame:
    """Pass 2: the records of each bucket in random order, with their ``place`` in it.

    Lists are sorted before they are shuffled and buckets are taken in order, so a task that runs again
    draws the same permutations.
    """
    sortable = F.struct(F.xxhash64("record").alias("h"), F.struct("record", "grown_shard").alias("r"))
    return (
        scattered.repartition("shard", "bucket")
        .groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(sortable), _by_hash).alias("records"))
        .sortWithinPartitions("shard", "bucket")
        .select("shard", "bucket", F.posexplode(F.shuffle("records", F.lit(seed + 2))).alias("place", "sorted"))
        .select("shard", "bucket", "place", "sorted.r.*")
    )


def _by_hash(a: Column, b: Column) -> Column:
    """Records of one hash are equal, whatever their types."""
    return F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)


def shard_records(
    records: DataFrame, key: str, size: Column, shards: int = 8, seed: int = 17, bucket_bytes: int = 4 << 20
) -> DataFrame:
    """All records with ``shard``, ``grown_shard``, ``bucket`` and a gapless ``slot`` per shard."""
    records = records.drop(*ADDED)
    total = records.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / shards / bucket_bytes))
    # There are at most as many large groups as buckets' worth of data.
    large = stored(large_groups(records, size, bucket_bytes))
    n_large = large.count()
    large = None if not n_large else F.broadcast(large) if n_large <= BROADCAST_BUCKETS else large
    written = stored(shuffle_buckets(scatter(records, key, shards, buckets, seed, large), seed))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        written.groupBy("shard", "bucket").count()
        .select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    if shards * buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)
    return written.join(starts, ["shard", "bucket"]).select(
        "record.*", "shard", "grown_shard", "bucket", (F.col("start") + F.col("place")).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; inside it one file per bucket at most, records in slot order."""
    (
        sharded.repartition("shard", "bucket").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
