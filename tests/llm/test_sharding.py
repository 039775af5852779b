from collections import defaultdict

from pyspark.sql import functions as F

from punctual.llm import sharding

def size():
    return F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)



def test_slots_are_gapless_and_rows_whole(odd):
    rows = sharding.shard_records(odd, "doc_id", size(), shards=3, bucket_bytes=2000).collect()
    assert sorted(map(str, [r[:3] for r in rows])) == sorted(map(str, [r[:3] for r in odd.select("doc_id", "text", "lang").collect()]))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 3) and r["record"] == "f" and r["start"] == "d"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_key_decides_and_growth_moves_only_into_the_new_shard(documents):
    one = {r["doc_id"]: r for r in sharding.shard_records(documents, "doc_id", size()).collect()}
    grown = {r["doc_id"]: r for r in sharding.shard_records(documents, "doc_id", size(), shards=9).collect()}
    assert {r["shard"] for r in one.values()} == set(range(8))
    for key, r in one.items():
        assert r["grown_shard"] == grown[key]["shard"]
        assert r["grown_shard"] in (r["shard"], 8)


def test_order_is_random_and_repeatable(documents):
    order = lambda seed: [r["doc_id"] for r in sharding.shard_records(documents, "doc_id", size(), 1, seed).orderBy("slot").collect()]
    first = order(3)
    assert first == order(3) and first != order(4) and first != sorted(first)


def test_native(documents):
    plan = sharding.shuffle_buckets(sharding.scatter(documents, "doc_id", 8, 4, 1), 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty(empty):
    assert sharding.shard_records(empty, "doc_id", size()).count() == 0


def test_written_shards(documents, tmp_path, spark):
    sharding.write_shards(sharding.shard_records(documents, "doc_id", size()), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()


def test_equal_rows_spread_over_buckets(frame):
    """A third of all rows are equal in every column, and as many have neither id nor text."""
    docs = frame([(7, "the same text again and again")] * 3000 + [(None, None)] * 3000 + [(k, f"text {k}") for k in range(3000)])
    rows = sharding.shard_records(docs, "doc_id", size(), shards=2, bucket_bytes=4000).select("doc_id", "shard", "bucket", "slot", "grown_shard").collect()
    assert len(rows) == 9000
    shards, of_key, buckets, slots = {}, defaultdict(set), defaultdict(set), defaultdict(list)
    for r in rows:
        shards.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        of_key[r["doc_id"]].add(r["shard"])
        buckets[r["doc_id"]].add((r["shard"], r["bucket"]))
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shards.values())
    assert len(buckets[7]) > 3 and len(buckets[None]) > 3
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_large_groups_are_exact(frame):
    docs = frame([(7, "x" * 100)] * 50 + [(8, "x" * 100)] * 5 + [(9, None)])
    found = sharding.large_groups(docs, size(), 1000).collect()
    assert [r["parts"] for r in found] == [-(-50 * (101 + sharding.ROW_BYTES) // 1000)]
