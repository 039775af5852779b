import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from punctual.llm import queries, substring_dedup
from llm.data import SF

LENGTH = substring_dedup.LENGTH


def brute(texts):
    """(removed, spans, kept) of each text, from all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + LENGTH] for d in data for k in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for k in range(len(d) - LENGTH + 1):
            if seen[d[k : k + LENGTH]] > 1:
                covered[k : k + LENGTH] = b"\1" * LENGTH
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((sum(covered), spans, bytes(b for b, c in zip(d, covered) if not c)))
    return out


def check(rows, docs):
    want = dict(zip([i for i, _ in docs], brute([t for _, t in docs])))
    for r in rows:
        assert (r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]


def test_query_equals_brute_force(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    want = dict(zip([i for i, _ in docs], brute([t for _, t in docs])))
    rows = queries.op7_suffix_dedup(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        removed, spans, kept = want[r["doc_id"]]
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (removed, spans, hashlib.sha256(kept).hexdigest())
        assert r["n_bytes"] == removed + len(kept)


def test_edges_of_the_length(frame):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghijkl é", k=n))
    shared = [noise(n) for n in (350, 380, 395, 400, 420, 700, 1500)]
    docs = [(k, noise(rng.randrange(300)) + s + noise(rng.randrange(300)) + (s if k % 3 == 0 else "")) for k, s in enumerate(shared * 3)]
    docs += [(100, "z" * 900), (101, "xy" * 450), (102, "xyz" * 140), (103, shared[5][:399]), (104, shared[6][3:403])]
    check(substring_dedup.remove_repeats(frame(docs)).collect(), docs)


def test_chunks_meet(frame, monkeypatch):
    rng = random.Random(4)
    data = "".join(rng.choices("abcdef", k=5000)).encode()
    monkeypatch.setattr(substring_dedup, "CHUNK", 700)
    first, last, place, _ = substring_dedup.anchor_runs(data)
    assert first[0] == 0 and last[-1] == len(data) - LENGTH and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + LENGTH - substring_dedup.ANCHOR)).all()


def test_odd_and_empty(odd, empty):
    rows = substring_dedup.remove_repeats(odd).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        assert r["n_bytes"] == r["n_removed"] + len(r["kept"]) and r["row"] == "a"
    assert len(rows) == odd.count()
    assert by[6][0]["n_removed"] == by[6][0]["n_bytes"] > 400 and by[6][0]["n_spans"] == 1
    assert by[1][0]["n_bytes"] == by[2][0]["n_bytes"] == 0 and by[9][0]["n_removed"] == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def rolled(texts, length=400):
    """(bytes removed, removed runs) per text, from 128-bit rolling hashes of every window of all texts, sorted at once."""
    one, two = [], []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint64) + np.uint64(1)
        for base, out in ((0x9E3779B97F4A7C15, one), (0xD1B54A32D192ED03, two)):
            if len(data) < length:
                out.append(np.zeros(0, np.uint64))
                continue
            base, top = np.uint64(base), np.uint64(pow(base, length, 1 << 64))
            # h(i) = sum of data[i + k] * base ** (length - 1 - k), by doubling the width.
            total, width, need = np.zeros(len(data) - length + 1, np.uint64), 0, length
            block, size, at = data, 1, 0
            while need:
                if need & 1:
                    total = total * np.uint64(pow(int(base), size, 1 << 64)) + block[at : at + len(total)]
                    at += size
                need >>= 1
                if need:
                    block = block[:-size] * np.uint64(pow(int(base), size, 1 << 64)) + block[size:]
                    size *= 2
            out.append(total)
    first, second = np.concatenate(one), np.concatenate(two)
    order = np.lexsort((second, first))
    same = np.zeros(len(first) + 1, bool)
    same[1:-1] = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    twice = np.zeros(len(first), bool)
    twice[order] = same[1:] | same[:-1]
    found, at = [], 0
    for text, hashes in zip(texts, one):
        edge = np.zeros(len((text or "").encode()) + 1, np.int64)
        starts = np.flatnonzero(twice[at : at + len(hashes)])
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + length, -1)
        covered = np.cumsum(edge)[:-1] > 0
        found.append((int(covered.sum()), int((np.diff(covered.astype(int), prepend=0) == 1).sum())))
        at += len(hashes)
    return found


def test_a_larger_table_by_rolling_hashes(spark):
    """Every window of sf0.01, with all its copies and shared passages."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d["doc_id"] for d in docs], rolled([d["text"] for d in docs])))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in queries.op7_suffix_dedup(spark, sf).collect()}
    assert got == want and sum(n > 0 for n, _ in want.values()) > 50
