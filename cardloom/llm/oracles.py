"""SQL for those queries that SQL can express; it compares all pairs that share a shingle, so it is for small tables."""

from __future__ import annotations

import string

from .license_scan import CONTAINMENT, PHRASES, SHINGLE, TEMPLATES

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc, min(root) AS root FROM r GROUP BY doc) m ON m.doc = d.doc_id
"""


def _words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _tokens(ws: str) -> str:
    return f"list_transform(range(1, len({ws}) - {SHINGLE - 2}), lambda i: array_to_string({ws}[i:i + {SHINGLE - 1}], ' '))"


def licenses() -> str:
    places = []
    for phrase, label in PHRASES.items():
        hit = " AND ".join(f"ws[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: coalesce({hit}, false)), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    low = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {', '.join(map(quoted, t))})" for i, t in enumerate(TEMPLATES))
    return f"""
WITH w AS (SELECT doc_id, {_words(_LOW)} AS ws FROM documents),
p AS (SELECT doc_id, ws, flatten([{', '.join(places)}]) AS hits FROM w),
t(template, label, wording, phrase) AS (VALUES {rows}),
u AS (SELECT template, label, {_words(low('wording'))} AS ws, {_words(low('phrase'))} AS ps FROM t),
s AS (SELECT template, label, len(ws) AS span, list_distinct(list_concat({_tokens('ws')}, {_tokens('ps')})) AS tokens, list_distinct({_tokens('ps')}) AS musts FROM u),
k AS (SELECT template, span, unnest(tokens) AS token FROM s),
g AS (SELECT doc_id, unnest(range(0, len(ws) - {SHINGLE - 1})) AS pos, unnest({_tokens('ws')}) AS token FROM w),
h AS (SELECT doc_id, template, pos // span AS b, token FROM g JOIN k USING (token)),
c AS (SELECT doc_id, template, b, list(DISTINCT token) AS common FROM (SELECT * FROM h UNION ALL SELECT doc_id, template, b - 1, token FROM h WHERE b > 0) GROUP BY ALL),
m AS (SELECT doc_id, label, len(common) / len(tokens) AS share FROM c JOIN s USING (template) WHERE len(common) >= ceil({CONTAINMENT} * len(tokens) - 1e-9) AND list_has_all(common, musts)),
f AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM m GROUP BY doc_id)
SELECT p.doc_id, len(ws) AS n_words, len(hits) AS n_base, list_min(list_transform(hits, lambda h: h.at)) AS first_word, list_max(list_transform(hits, lambda h: h.at)) AS last_word,
 coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h.label))), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(hits, lambda h: h.label), coalesce(f.labels, []::VARCHAR[])))), ','), '') AS labels,
 CASE WHEN len(hits) > 0 THEN 1.0 ELSE coalesce(f.share, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN f ON f.doc_id = p.doc_id
"""
