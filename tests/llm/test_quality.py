import re
from collections import Counter

from punctual.llm import quality, queries
from llm.data import SF


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(ws) < 10 or 100 * len(covered) > 20 * len(ws),
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_equals_brute_force(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = queries.op8_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in BASE) == brute(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_verdicts_follow_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed").collect()
    good = [r for r in judged if r["quality"] == 1]
    bad = [r for r in judged if r["quality"] == 0]
    assert all(r["kept"] for r in good)
    assert sum(not r["kept"] for r in bad) > len(bad) / 2


TEXTS = ["a b c d e " * 4, "é ñ😀 | <b> \x0b x", "x\ny\nx\n\n \nx", "one two three four five", "a b c d e f a b c d e g", "a a a a a a a a a a a a"]


def test_counts(frame):
    got = {r["doc_id"]: r for r in quality.judge(frame(list(enumerate(TEXTS)))).collect()}
    for k, text in enumerate(TEXTS):
        assert tuple(got[k][c] for c in BASE) == brute(text), text


def test_odd_and_empty(odd, empty):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["base_failed"] for r in rows if not (r["text"] or "").strip())
    assert {r["ref_lang"] for r in rows} == {"h"}
    assert quality.judge(empty).count() == 0


def test_distance_of_equal_and_disjoint(spark):
    got = spark.sql("SELECT array(1,3) a, array(0.25D,0.75D) q, array(0.0D,0.0D) z").select(
        quality.char_distance(quality.F.col("a"), quality.F.col("q")).alias("same")
    ).first()
    assert got["same"] == 0.0


def test_native(spark, documents):
    assert "Python" not in quality.judge(documents)._jdf.queryExecution().toString()
