import numpy as np

from punctual.llm import langid, queries
from llm.data import SF


def test_held_out_accuracy(spark, documents):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(labels) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_learns_only_from_the_other_fold(spark, documents, tmp_path):
    """Other labels on held-out rows change no prediction."""
    F = langid.F
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    documents.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(str(tmp_path / "documents.parquet"))
    one = queries.op4_language_id(spark, SF).collect()
    two = queries.op4_language_id(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_slices_have_every_gram_once(monkeypatch):
    text = "some text äöü 😀 of a few words " * 9
    whole = sorted(int(i) for ids in langid._slices(text) for i in ids)
    monkeypatch.setattr(langid, "SLICE", 17)
    assert sorted(int(i) for ids in langid._slices(text) for i in ids) == whole
    n = len(text) + 2
    assert len(whole) == n + n - 1 + n - 2


def test_odd_and_empty(odd, empty, documents):
    model = langid.train(documents)
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in (1, 2, 3, 4))
    assert rows[5]["lang_pred"] == "en" and rows[5]["row"] == "a"
    assert langid.predict(empty, model).count() == 0
    nothing = langid.train(empty)
    assert nothing[0] == [] and {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_numerals_are_no_letters():
    model = (["en"], np.zeros((langid.BUCKETS, 1), np.float32))
    assert [langid.classify(t, *model)[0] for t in ("½ ² ①", "Ⅷ _ 7", "Ⅷ a", "ª", "字")] == ["und", "und", "en", "en", "en"]
