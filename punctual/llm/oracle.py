"""DuckDB SQL for the text queries that SQL can express, written from the definitions and not from the Spark code."""

from __future__ import annotations

#: Shortest runs of ten words from each line and up to each line; of equal runs all but the first go.
LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
w AS (SELECT doc_id, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
c AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
             sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before FROM w),
r AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.upto >= a.before + 10 GROUP BY ALL
      UNION
      SELECT b.doc_id, max(a.i) AS i, b.i AS j FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.upto >= a.before + 10
      GROUP BY b.doc_id, b.i),
t AS (SELECT r.*, array_to_string(ls[i + 1 : j + 1], chr(10)) AS content FROM r JOIN d USING (doc_id)),
later AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY content, j - i ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, j + 1)) AS k FROM later) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed_lines,
  coalesce(array_to_string(list_sort(ks), ','), '') AS removed_lines,
  md5(coalesce(array_to_string([ls[k + 1] FOR k IN range(len(ls)) IF ks IS NULL OR NOT list_contains(ks, k)], chr(10)), '')) AS kept_md5
FROM d LEFT JOIN gone USING (doc_id)"""

#: Every run with a word in it: shortest runs of one word from each line and up to each line.
ANY_LINE_DEDUP = LINE_DEDUP.replace("a.before + 10", "a.before + 1")


#: Counts, both histograms and their Jensen-Shannon distance to those of the language, and the verdict.
QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
ws AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
x AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(len(w))) AS i FROM ws),
g AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
             || ' ' || lead(word, 4) OVER o AS gram FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM (SELECT * FROM g WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1), range(5) AS r(k) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
ch AS (SELECT doc_id, lang, len(t) AS n, unnest(['[^a-z]', '[^A-Z]', '[^\x20\x09-\x0D]', '[^.,;:!?''()-]', '(?s).', '[^\p{N}]', '(?s).']) AS pattern,
              unnest(range(7)) AS k, t FROM d),
cc AS (SELECT doc_id, lang, n, k, len(regexp_replace(CASE k WHEN 4 THEN regexp_replace(t, '[^\p{L}]', '', 'g') ELSE t END,
              CASE k WHEN 4 THEN '[a-zA-Z]' WHEN 6 THEN '[a-zA-Z\x20\x09-\x0D.,;:!?''()\p{L}\p{N}-]' ELSE pattern END, '', 'g')) AS c FROM ch),
cref AS (SELECT lang, k, sum(c) / greatest(sum(sum(c)) OVER (PARTITION BY lang), 1) AS q FROM cc GROUP BY lang, k),
wc AS (SELECT lang, CASE WHEN len(lower(word)) <= 5 THEN lower(word) END AS word, count(*) AS c FROM x GROUP BY ALL),
tot AS (SELECT lang, sum(c) AS total FROM wc GROUP BY lang HAVING sum(c) >= 5000),
top AS (SELECT lang, word, c / total AS q FROM wc JOIN tot USING (lang) WHERE word IS NOT NULL AND NOT contains(word, ',')
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) <= 40),
wref AS (SELECT * FROM top UNION ALL SELECT lang, NULL, 1 - sum(q) FROM top GROUP BY lang),
wp AS (SELECT doc_id, x.lang, top.word, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p
       FROM x LEFT JOIN top ON top.lang = x.lang AND top.word = lower(x.word) AND len(x.word) <= 5 GROUP BY doc_id, x.lang, top.word),
wj AS (SELECT ws.doc_id, r.q, coalesce(wp.p, 0) AS p FROM ws JOIN wref r USING (lang)
       LEFT JOIN wp ON wp.doc_id = ws.doc_id AND wp.word IS NOT DISTINCT FROM r.word WHERE len(ws.w) >= 50),
cj AS (SELECT doc_id, q, c / n AS p FROM cc JOIN cref USING (lang, k) JOIN tot USING (lang) WHERE n >= 200),
term AS (SELECT 'w' AS kind, * FROM wj UNION ALL SELECT 'c', * FROM cj),
js AS (SELECT kind, doc_id, sqrt(least(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
              + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0), 1)) AS dist FROM term GROUP BY ALL),
m AS (SELECT ws.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([len(v) FOR v IN w]), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, jc.dist AS char_distance, jw.dist AS word_distance
      FROM ws LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
      LEFT JOIN js jc ON jc.doc_id = ws.doc_id AND jc.kind = 'c' LEFT JOIN js jw ON jw.doc_id = ws.doc_id AND jw.kind = 'w'),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT * REPLACE (round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance),
  NOT base_failed AND coalesce(char_distance, 0) <= 0.28 AND coalesce(word_distance, 0) <= 0.45 AS kept FROM f"""


#: All documents against all items, by the contract's whole-number formulas.
RANKED_SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
           FROM documents),
full_d AS (SELECT * FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM full_d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM full_d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT k, item_id, t, count(*) AS times FROM (
        SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark) GROUP BY ALL),
m AS (SELECT r, doc_id, 75 + (25 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM full_d, g),
s AS (SELECT k, item_id, doc_id, r, sum(times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS score
      FROM q JOIN tf USING (t) JOIN df USING (t) JOIN m USING (r), g GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20"""

#: Every query against every row. Where one block holds all nodes, the graph search finds them all.
NEAREST = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda x, y: x + y)) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_line_dedup": LINE_DEDUP, "op6_line_dedup_any": ANY_LINE_DEDUP, "op8_quality_rules": QUALITY,
        "op12_ranked_search": RANKED_SEARCH, "op13_nearest_neighbours": NEAREST,
    }
