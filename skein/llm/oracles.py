"""DuckDB SQL of the pN_ queries that SQL can express over whole tables.

Those of p1, p4 and p5 compare all sets of windows or word runs exactly, so
they show what the searches find and lose; they are for the sizes of the test
tables. p7 needs compatibility forms, p8 a tokenizer and hashes of the same
kind, p9 rules of scripts, p2_statistics sketches and p6_assignment hashes of
the same kind: these are held against brute force, or what must hold of them,
in tests/llm.
"""

from __future__ import annotations

REC = "rec AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY retrieved_at::TIMESTAMPTZ DESC) AS rn FROM astronomy_sample WHERE document_id IS NOT NULL) WHERE rn = 1)"
W = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_P2 = rf"""WITH {REC},
t AS (SELECT document_id, text, regexp_extract_all(text, '[^{W}]+') AS w, length(regexp_replace(text, '[{W}]+', '', 'g')) AS visible, length(regexp_replace(text, '[{W}\p{{L}}\p{{N}}]+', '', 'g')) AS symbols,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[{W}]+', ''), '[{W}]+$', '')), lambda x: x <> '') AS ln FROM rec WHERE text IS NOT NULL),
c AS (SELECT list(DISTINCT word) AS cw FROM common_words),
s AS (SELECT document_id, len(w) AS n, visible::DOUBLE / len(w) AS mean, symbols::DOUBLE / visible AS sym, len(list_filter(ln, lambda x: x[-1:] IN ('.', '!', '?', '…', '"', '”', '’', ')', '»')))::DOUBLE / len(ln) AS ended,
  len(list_filter(w, lambda x: list_contains(cw, regexp_replace(lower(x), '[^\p{{L}}]+', '', 'g'))))::DOUBLE / len(w) AS common FROM t, c WHERE len(w) > 0)
SELECT document_id FROM s WHERE (n < 30)::INT + (mean < 3.5 OR mean > 8.0)::INT + (sym > 0.12)::INT + (ended < 0.25)::INT + (common < 0.15)::INT >= 2"""

_LINES = rf"""WITH {REC},
l AS (SELECT document_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM rec WHERE text IS NOT NULL),
k AS (SELECT document_id, source, line_no::BIGINT AS line_no, regexp_replace(lower(line), '[^\p{{L}}]+', '', 'g') AS key FROM l),
g AS (SELECT source, key, count(DISTINCT document_id) AS n FROM k WHERE length(key) >= 12 GROUP BY ALL),
n AS (SELECT source, count(*) AS total FROM rec GROUP BY source),
h AS (SELECT g.source, g.key FROM g JOIN n USING (source) WHERE g.n >= 4 AND g.n >= 0.02 * total)"""
_P3 = f"{_LINES} SELECT document_id, line_no FROM k JOIN h USING (source, key)"
_P3_LINES = f"""{_LINES},
d AS (SELECT DISTINCT k.source, k.key, rec.text, left(rec.published_at, 10) AS day, k.document_id FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source AND k.key = h.key JOIN rec USING (document_id))
SELECT d.source, d.key AS letters, count(DISTINCT d.document_id) AS n_records, count(DISTINCT d.text) AS n_texts, count(DISTINCT d.day) AS n_days, any_value(n.total) AS source_records FROM d JOIN n ON n.source IS NOT DISTINCT FROM d.source GROUP BY d.source, d.key"""
_P3_CLEANED = rf"""{_LINES},
x AS (SELECT l.document_id, l.line_no, l.line, h.key IS NOT NULL AS hit FROM l JOIN k ON k.document_id = l.document_id AND k.line_no = l.line_no LEFT JOIN h ON h.source = k.source AND h.key = k.key),
o AS (SELECT document_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT hit), '') AS text, count(*) FILTER (hit) AS removed FROM x GROUP BY document_id)
SELECT rec.document_id, o.text, coalesce(o.removed, 0) AS removed FROM rec LEFT JOIN o USING (document_id)"""

_EDGES = rf"""{REC},
r AS (SELECT document_id AS d, lower(trim(split)) AS s, nullif(lower(regexp_extract(dedup_cluster_id, '(?:^|[^0-9a-fA-F])([0-9a-fA-F]{{16}})(?:$|[^0-9a-fA-F])', 1)), '') AS c, source, source_record_id AS i FROM rec),
star AS (SELECT r.d, m.root FROM r JOIN (SELECT c, min(d) AS root FROM r WHERE c IS NOT NULL GROUP BY c) m USING (c) UNION SELECT r.d, m.root FROM r JOIN (SELECT source, i, min(d) AS root FROM r WHERE source IS NOT NULL AND i IS NOT NULL GROUP BY ALL) m USING (source, i)),
e AS (SELECT d AS a, root AS b FROM star UNION SELECT root, d FROM star),
w AS (SELECT d AS a, d AS b FROM r UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
comp AS (SELECT a AS d, min(b) AS root FROM w GROUP BY a)"""
_P6 = f"WITH RECURSIVE {_EDGES} SELECT root AS group_id FROM comp JOIN r USING (d) WHERE s IN ('train', 'validation', 'test', 'probe', 'cloze_reserve') GROUP BY root HAVING count(DISTINCT s) > 1"

_WINDOWS = f"""{REC},
u AS (SELECT document_id, text, unnest(range(1, length(text) - 158)) AS i FROM rec WHERE length(text) >= 160),
w AS (SELECT document_id, i, substr(text, i, 160) AS g FROM u),
s AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT document_id) > 1)"""
_P1 = f"""WITH {_WINDOWS}, x AS (SELECT DISTINCT document_id, g FROM w SEMI JOIN s USING (g))
SELECT DISTINCT a.document_id AS document_id_a, b.document_id AS document_id_b FROM x a JOIN x b ON a.g = b.g AND a.document_id < b.document_id"""
_P1_COVERAGE = f"""WITH {_WINDOWS},
x AS (SELECT document_id, i, lead(i) OVER (PARTITION BY document_id ORDER BY i) - i AS gap FROM w SEMI JOIN s USING (g)),
c AS (SELECT document_id, sum(least(160, coalesce(gap, 160)))::BIGINT AS chars, count(*) FILTER (gap IS NULL OR gap > 160) AS spans FROM x GROUP BY document_id)
SELECT document_id, coalesce(length(text), 0) AS n_chars, coalesce(chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(chars, 0) / length(text), 6) ELSE 0.0 END AS shared_share, coalesce(spans, 0) AS n_spans FROM rec LEFT JOIN c USING (document_id)"""

_SETS = rf"""{REC},
v AS (SELECT document_id, split, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS v FROM rec WHERE text IS NOT NULL),
g AS (SELECT document_id, lower(trim(split)) AS split, unnest(list_distinct(list_transform(range(1, len(v) - 3), lambda i: array_to_string(v[i:i + 4], ' ')))) AS g FROM v WHERE len(v) >= 20),
n AS (SELECT document_id, count(*) AS n FROM g GROUP BY document_id)"""
_NEAR = f"""{_SETS},
b AS (SELECT x.document_id AS a, y.document_id AS b, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.document_id < y.document_id GROUP BY ALL),
near AS (SELECT a, b, i::DOUBLE / (p.n + q.n - i) AS sim FROM b JOIN n p ON p.document_id = a JOIN n q ON q.document_id = b)"""
_P4 = f"WITH {_NEAR} SELECT a AS document_id_a, b AS document_id_b FROM near WHERE sim >= 0.7"
_P4_GROUPS = f"""WITH RECURSIVE {_NEAR},
e AS (SELECT a, b FROM near WHERE sim >= 0.8 UNION SELECT b, a FROM near WHERE sim >= 0.8),
t AS (SELECT min(document_id) AS first, text FROM rec WHERE text <> '' GROUP BY text),
k AS (SELECT document_id AS a, document_id AS b FROM rec UNION SELECT k.a, e.b FROM k JOIN e ON k.b = e.a),
m AS (SELECT a AS document_id, min(b) AS group_id FROM k GROUP BY a),
z AS (SELECT m.document_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, row_number() OVER (PARTITION BY group_id ORDER BY length(coalesce(text, '')) DESC, m.document_id) AS r FROM m JOIN rec USING (document_id) WHERE document_id IN (SELECT document_id FROM n)),
short AS (SELECT r.document_id, coalesce(t.first, r.document_id) AS group_id, count(*) OVER (PARTITION BY coalesce(t.first, r.document_id)) AS group_size FROM rec r LEFT JOIN t ON t.text = r.text WHERE r.document_id NOT IN (SELECT document_id FROM n))
SELECT document_id, group_id, group_size, r = 1 AS is_representative FROM z UNION ALL SELECT document_id, document_id, 1, TRUE FROM short"""
_HELD = "('validation', 'test', 'probe', 'cloze_reserve')"
_LEAKS = f"""{_SETS},
b AS (SELECT x.document_id AS e, y.document_id AS t, count(*) AS i FROM g x JOIN g y ON x.g = y.g WHERE x.split IN {_HELD} AND y.split = 'train' GROUP BY ALL),
leak AS (SELECT e, t, i::DOUBLE / n AS share FROM b JOIN n ON n.document_id = e WHERE i::DOUBLE / n >= 0.7)"""
_P5 = f"WITH {_LEAKS} SELECT least(e, t) AS document_id_a, greatest(e, t) AS document_id_b FROM leak"
_P5_REPORT = f"""WITH {_LEAKS}, r AS (SELECT document_id AS e, lower(trim(split)) AS split, source FROM rec), c AS (SELECT e, count(*) AS k FROM leak GROUP BY e)
SELECT split, source, count(*) AS eval_records, count(k) AS leaked_records, coalesce(sum(k), 0)::BIGINT AS pairs FROM r LEFT JOIN c USING (e) WHERE split IN {_HELD} GROUP BY split, source"""

_P5_COVERAGE = rf"""WITH {_LEAKS},
q AS (SELECT document_id AS e, v, unnest(range(1, len(v) - 3)) AS i FROM v WHERE document_id IN (SELECT e FROM leak)),
o AS (SELECT leak.e, leak.t, q.i, lead(q.i) OVER (PARTITION BY leak.e, leak.t ORDER BY q.i) - q.i AS gap FROM leak JOIN q ON q.e = leak.e JOIN g ON g.document_id = leak.t AND g.g = array_to_string(q.v[q.i:q.i + 4], ' ')),
a AS (SELECT e, t, sum(least(5, coalesce(gap, 5)))::BIGINT AS aligned FROM o GROUP BY e, t)
SELECT leak.e AS document_id, lower(trim(rec.split)) AS split, rec.source, count(*) AS pairs, round(max(share), 6) AS best_share, max(aligned) AS aligned_words, max(len(v.v)) AS words FROM leak JOIN a USING (e, t) JOIN rec ON rec.document_id = leak.e JOIN v ON v.document_id = leak.e GROUP BY ALL"""

ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p1_shared_coverage": _P1_COVERAGE,
    "p2_found": _P2,
    "p3_found": _P3,
    "p3_repeated_lines": _P3_LINES,
    "p3_cleaned": _P3_CLEANED,
    "p4_found": _P4,
    "p4_groups": _P4_GROUPS,
    "p5_found": _P5,
    "p5_leak_report": _P5_REPORT,
    "p5_coverage": _P5_COVERAGE,
    "p6_found": _P6,
}
