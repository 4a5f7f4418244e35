"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = "string_split_regex(trim(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' ')"
#: words of each document, one row each: doc_id, i (from 1), w
TOKENS = f"""
toks AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, list_filter({WORDS}, lambda x: x <> '') AS ws FROM documents))"""


def _window(width: int) -> str:
    return " || ' ' || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(width))


ORACLE = {
    "op3_substring_dedup": f"""
WITH {TOKENS},
win AS (
  SELECT doc_id, i, {_window(13)} AS k FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
low AS (SELECT k, min(doc_id) AS first_id FROM win WHERE k IS NOT NULL GROUP BY k),
hit AS (SELECT doc_id, i FROM win JOIN low USING (k) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
marked AS (SELECT t.doc_id, t.i, t.w, g.i IS NOT NULL AS removed
           FROM toks t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i)
SELECT d.doc_id, count(m.i)::BIGINT AS n_words,
  count(*) FILTER (m.removed)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(m.w, ' ' ORDER BY m.i) FILTER (NOT m.removed), '')) AS kept_sha256
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",

    "op4_quality_rules": f"""
WITH {TOKENS},
win AS (SELECT doc_id, i, {_window(5)} AS k,
          lag(w) OVER o AS prev, w
        FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
often AS (SELECT doc_id, k FROM win WHERE k IS NOT NULL GROUP BY doc_id, k HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM
          (SELECT win.doc_id, unnest(range(i, i + 5)) AS j FROM win JOIN often USING (doc_id, k)) GROUP BY doc_id),
base AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars,
           count(*) FILTER (w = prev) AS stutters,
           count(*) FILTER (regexp_matches(w, '[A-Za-z]|[^\\x00-\\x7F]')) AS lettered
         FROM win GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM
            (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(b.n_words, 0)::BIGINT AS n_words, coalesce(b.word_chars, 0)::BIGINT AS word_chars,
        length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
        coalesce(l.n, 0) AS n_lines, coalesce(b.stutters, 0) AS stutters, coalesce(b.lettered, 0) AS lettered
      FROM documents d LEFT JOIN base b USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN cov c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 10 * n_symbols > n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words
  AND NOT 10 * n_dup_lines > 7 * n_lines AND NOT 5 * stutters > n_words AND NOT 2 * lettered < n_words AS kept
FROM f""",

    "op12_ranked_search": """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
held AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) GROUP BY r, t),
total AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM docs WHERE len(ts) > 0),
weight AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
           FROM held, total GROUP BY t, n),
asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
scored AS (
  SELECT a.item_id, a.text, h.r, d.doc_id, sum(w.w * ((1000000000 * h.tf) //
    (1000 * h.tf + 8 * (10 + (90 * len(d.ts) * total.n) // total.l))))::BIGINT AS score
  FROM asked a JOIN weight w USING (t) JOIN held h USING (t) JOIN docs d ON d.r = h.r, total
  GROUP BY a.item_id, a.text, h.r, d.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
