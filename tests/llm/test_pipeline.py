import importlib
import re

import pytest

import __spark_entry__ as registry
import corpus_pipeline
from punctual.llm.common import stored
from llm.data import SF
from llm.test_decontamination import plain
from llm.test_near_dedup import brute as groups, shingles
from llm.test_packing import check, ids_of


@pytest.fixture(scope="module")
def steps(spark, documents):
    out, docs = [documents], documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_stages_and_columns(steps, documents):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert all(step.dtypes == documents.dtypes for step in steps[:-1])


def test_each_stage_on_its_input(spark, steps):
    rows = [{r["doc_id"]: r for r in step.collect()} for step in steps[:-1]]
    assert set(rows[0]) > set(rows[1]) >= set(rows[2]) >= set(rows[3]) >= set(rows[4])
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2].values())
    group = groups([(i, r["text"]) for i, r in rows[2].items()], 5)
    assert set(rows[3]) == {i for i, r in rows[2].items() if group[i] == i or not shingles(r["text"], 5)}
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, r in rows[3].items() if any(t in plain(r["text"]) for t in items)}
    assert set(rows[4]) == set(rows[3]) - leaked
    packed = steps[5].selectExpr("*", "crc32(ids) AS crc").collect()
    check(packed, dict(zip(rows[4], ids_of([r["text"] for r in rows[4].values()]))))


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, SF).groupBy().sum("length").first() == steps[5].groupBy().sum("length").first()


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, odd, SF).columns == odd.columns


def test_registered():
    names = registry.queries()
    assert "pipeline" in names
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))


def test_entry_works_without_the_text_operators(monkeypatch):
    real = importlib.import_module

    def missing(name, *rest):
        if name.startswith(("punctual.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name.removesuffix(".queries"))
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert registry._optional("punctual.llm.queries") is None and registry._optional("corpus_pipeline") is None
