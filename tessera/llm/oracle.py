"""DuckDB SQL for the operators that SQL can express: near-duplicates, rules, licenses and hard negatives."""

from __future__ import annotations

import string

from tessera.llm import license_scan, rule_ledger

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"regexp_extract_all({}, '[^ \t-\r]+')"


def near_dedup(percent: int = 80) -> str:
    """Two-word shingles of whole texts, all pairs that share one, and the closure of the links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS o, b AS t FROM e UNION SELECT r.o, e.b FROM r JOIN e ON e.a = r.t),
m AS (SELECT o, min(t) AS t FROM r GROUP BY o)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.t, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.t, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.o = d.doc_id"""


def rules(policy: str = rule_ledger.CURRENT) -> str:
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(rule_ledger.RULES.values()))
    base = sum(rule_ledger.bit(r) for r in rule_ledger.BASE)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, {_WORDS.format("text")} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM d WHERE len(w) > 2),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, CAST(length(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(regexp_replace(text, '[^A-Za-z\x{{80}}-\x{{10FFFF}}]', '', 'g')) AS BIGINT) AS n_letters, CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t-\r]*$'))) AS BIGINT) AS n_ellipsis_lines FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)
SELECT *, failed_bits & {base} <> 0 AS base_failed, failed_bits & {rule_ledger.mask(policy) | base} = 0 AS kept, '{policy}' AS policy FROM b"""


def licenses(percent: int = license_scan.PERCENT) -> str:
    templates = ", ".join(f"('{label}', {sorted(set(text.split()))}, {license_scan.need(len(set(text.split())), percent)})" for label, text in license_scan.TEMPLATES)
    word = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"
    places = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, unnest([i - 1 FOR i IN range(1, len(w) - {len(p.split()) - 2}) IF " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + "]) AS spot FROM d" for p, label in license_scan.PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, {_LOWER} AS low, regexp_extract_all({_LOWER}, {word}) AS w FROM documents), p AS ({places}),
t(label, words, least) AS (VALUES {templates}),
b AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(regexp_split_to_array(low, '\n[ \t\x0B\f\r]*\n')), {word})) AS own FROM d),
f AS (SELECT doc_id, label, len(list_intersect(words, own)) / len(words) AS c FROM b JOIN t ON len(list_intersect(words, own)) >= least),
q AS (SELECT doc_id, count(*) AS n, min(spot) AS a, max(spot) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM f) GROUP BY doc_id),
x AS (SELECT doc_id, max(c) AS c FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(q.n, 0) AS n_base, q.a AS first_word, q.z AS last_word, coalesce(q.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN q.n > 0 THEN 1.0::DOUBLE ELSE coalesce(x.c, 0.0) END AS score
FROM d LEFT JOIN q ON q.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id"""


def hard_negatives() -> str:
    """All anchors against all rows, over components that became integers."""
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE k <= 5)
SELECT * FROM n WHERE rank <= 10"""


ORACLE_SQL = {"op4_near_dedup": near_dedup(), "op8_rules": rules(), "op10_license_scan": licenses(), "op11_hard_negatives": hard_negatives()}
