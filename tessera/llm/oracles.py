"""DuckDB SQL of the queries whose rows SQL can express."""

from __future__ import annotations

from tessera.llm import chat
from tessera.llm.licences import PHRASES, bounds
from tessera.llm.notices import TEMPLATES

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- Of the sorted shingles of a text, a similar one must share one of the first n - ceil(0.8 n) + 1.
f AS (SELECT shingle, count(*) AS c FROM s GROUP BY shingle),
o AS (SELECT s.doc_id, s.shingle, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.c, s.shingle) AS r FROM s JOIN f USING (shingle) JOIN n USING (doc_id)),
p AS (SELECT doc_id, shingle, n FROM o WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p AS a JOIN p AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
k AS (SELECT c.a, c.b, count(*) AS k FROM c JOIN s AS x ON x.doc_id = c.a JOIN s AS y ON y.doc_id = c.b AND y.shingle = x.shingle GROUP BY c.a, c.b),
l AS (SELECT k.a, k.b FROM k JOIN n AS x ON x.doc_id = k.a JOIN n AS y ON y.doc_id = k.b WHERE 100 * k.k >= 80 * (x.n + y.n - k.k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM t GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, doc_id = m.root AS kept FROM m LEFT JOIN n USING (doc_id)
"""


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SIZES = ",\n".join(f"({i}, '{t[0]}', {len(b[0])}, {b[1]}, {b[2]}, {len(t[2])})" for i, t in enumerate(TEMPLATES) for b in [bounds(t)])
_TOKENS = ",\n".join(f"({i}, 0, {_listed([w])})" for i, t in enumerate(TEMPLATES) for w in bounds(t)[0])
_TELLS = ",\n".join(f"({i}, {j}, {_listed(p.split())})" for i, t in enumerate(TEMPLATES) for j, p in enumerate(t[2], 1))


def _phrase(phrase: str, label: str) -> str:
    parts = phrase.split()
    match = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return f"SELECT rid, '{label}' AS label, i - 1 AS place FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {len(parts) - 2}, 1))) AS i FROM d WHERE list_contains(w, '{parts[-1]}')) WHERE {match}"


_PHRASES_SQL = "\nUNION ALL ".join(_phrase(p, x) for p, x in PHRASES.items())
LICENCES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
m(tmpl, label, n, need, width, tells) AS (VALUES {_SIZES}),
-- What is looked for: single words (kind 0) and telling phrases.
k(tmpl, kind, said) AS (VALUES {_TOKENS},
{_TELLS}),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
h AS (SELECT x.rid, k.tmpl, k.kind, k.said, x.pos, len(d.w) AS n_words FROM x JOIN k ON k.said[1] = x.word JOIN d ON d.rid = x.rid WHERE d.w[x.pos:x.pos + len(k.said) - 1] = k.said),
g AS (SELECT rid, tmpl, kind, said, pos, n_words, coalesce(lag(pos) OVER (PARTITION BY rid, tmpl, kind, said ORDER BY pos), 0) AS prev FROM h),
-- The windows' beginnings from which a place is the first of its kind.
c AS (SELECT rid, tmpl, kind, greatest(prev + 1, pos + len(said) - width) AS a, least(pos, greatest(n_words - width + 1, 1)) AS z FROM g JOIN m USING (tmpl)),
e AS (SELECT rid, tmpl, kind, a AS begin_at, 1 AS v FROM c WHERE a <= z UNION ALL SELECT rid, tmpl, kind, z + 1, -1 FROM c WHERE a <= z),
s AS (SELECT rid, tmpl, begin_at, sum(CASE WHEN kind = 0 THEN v ELSE 0 END) AS w0, sum(CASE WHEN kind > 0 THEN v ELSE 0 END) AS w1 FROM e GROUP BY rid, tmpl, begin_at),
r AS (SELECT rid, tmpl, sum(w0) OVER o AS hits, sum(w1) OVER o AS told FROM s WINDOW o AS (PARTITION BY rid, tmpl ORDER BY begin_at)),
b AS (SELECT rid, label, max(hits / n::DOUBLE) AS containment FROM r JOIN m USING (tmpl) WHERE hits >= need AND told = tells GROUP BY rid, label),
p AS ({_PHRASES_SQL}),
pb AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY rid),
y AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM p) GROUP BY rid),
t AS (SELECT rid, max(containment) AS score FROM b GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN pb USING (rid) LEFT JOIN y USING (rid) LEFT JOIN t USING (rid)
"""

ORACLES = {"op2_chat": chat.ORACLE, "op5_minhash": NEAR_DUPLICATES, "op10_licences": LICENCES}
