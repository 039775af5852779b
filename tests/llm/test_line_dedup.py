import re
from collections import defaultdict

import corpus_pipeline
from punctual.llm import line_dedup, queries
from llm.data import SF


def brute(docs, least):
    """Removed lines of each document: every run of lines, whatever its length, against all runs before it."""
    runs, gone = defaultdict(list), defaultdict(set)
    for key, text in sorted(docs, key=lambda d: d[0]):
        lines = text.split("\n")
        for i in range(len(lines)):
            n = 0
            for j in range(i, len(lines)):
                n += len(re.findall(r"[^\x20\x09-\x0D]+", lines[j]))
                if n >= least:
                    runs[tuple(lines[i : j + 1])].append((key, i, j))
    for places in runs.values():
        for key, i, j in places[1:]:
            gone[key].update(range(i, j + 1))
    return gone


def test_query_equals_brute_force(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect() if len(r["text"].split("\n")) < 60]
    keep = {d for d, _ in docs}
    got = line_dedup.drop_repeated_lines(documents.where(documents.doc_id.isin(*keep)))
    want = brute(docs, line_dedup.LEAST_WORDS)
    for r in got.collect():
        assert r["removed_lines"] == sorted(want[r["doc_id"]]), r["doc_id"]
    assert queries.op6_line_dedup(spark, SF).count() == documents.count()


SMALL = [
    (1, "a b c\nd e\n\nf\ng h"), (2, "x\nd e\n\nf\ny"), (3, "a b c\nd e\n\nf\ng h"), (4, "f\ng h\nf\ng h\nf"), (5, "\n\n\n"), (6, "a\nb\nc\nd\ne\na\nb\nc\nd\ne"),
    (7, "e\na\nb"), (8, "q q q q\nq q q q\nq q q q"),
]


def test_small_runs(frame):
    for least in (1, 3, 4, 6):
        want = brute(SMALL, least)
        for r in line_dedup.drop_repeated_lines(frame(SMALL), least=least).collect():
            assert r["removed_lines"] == sorted(want[r["doc_id"]]), (least, r["doc_id"])
            lines = dict(SMALL)[r["doc_id"]].split("\n")
            assert r["text"] == "\n".join(x for k, x in enumerate(lines) if k not in want[r["doc_id"]])
            assert r["n_lines"] == len(lines) and r["hash"] == "b" and r["line"] == "c"


def test_short_lines_are_taken(spark, frame, documents):
    """No line with a word stands twice in what the query of any length and the stage keep."""
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    text, left, cut = dict(docs), [], 0
    for r in queries.op6_line_dedup_any(spark, SF).collect():
        gone = {int(k) for k in r["removed_lines"].split(",") if k}
        cut += len(gone)
        left += [x for k, x in enumerate(text[r["doc_id"]].split("\n")) if k not in gone and x.strip(" \t\v\f\r")]
    assert cut and len(left) == len(set(left))
    kept = corpus_pipeline.repeated_lines(spark, frame([(1, "a b\nRead more\nc"), (2, "Read more\nd"), (3, "Read more")]), SF).collect()
    assert sorted(r["text"] for r in kept) == ["a b\nRead more\nc", "d"]


def test_rows_that_are_twice_in_the_table(frame):
    """Short lines shared by two documents stay, though each document's rows repeat."""
    docs = [(1, "one a b c d e\nshared f g h i\nlast of the first"), (2, "other a b c\nshared f g h i\nlast of two"), (3, "p q\nr s")]
    want = brute(docs, 10)
    assert not any(want.values())
    rows = line_dedup.drop_repeated_lines(frame(2 * docs + docs[:1]), least=10).collect()
    assert len(rows) == 7
    assert all(r["removed_lines"] == [] and r["text"] == dict(docs)[r["doc_id"]] for r in rows)


def test_odd_and_empty(odd, empty):
    rows = line_dedup.drop_repeated_lines(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    # The null id comes first, so its copy of the text stays; equal rows are one document.
    assert [r["n_removed_lines"] for r in by[6]] == [1] and [r["text"] for r in by[7]] == ["", ""]
    assert {r["text"] for r in by[None]} == {None, next(r["text"] for r in odd.where("doc_id = 6").collect())}
    assert by[1][0]["text"] is None and by[5][0]["n_removed_lines"] == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0
