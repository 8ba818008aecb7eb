"""Named queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .embeddings import op4_embeddings
from .lines import op7_lines
from .lm import op5_lm
from .media import op10_media
from .mixing import op6_mixing
from .passages import op9_passages
from .pieces import op8_pieces
from .simhash import op2_simhash
from .quality import op3_quality
from .tokens import op1_tokens

QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op4_embeddings": op4_embeddings,
    "op5_lm": op5_lm,
    "op6_mixing": op6_mixing,
    "op7_lines": op7_lines,
    "op8_pieces": op8_pieces,
    "op9_passages": op9_passages,
    "op10_media": op10_media,
}

#: All pairs of a label by their cosine, and components by walking along links.
_EMBEDDINGS = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT r, vec_id, label, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM ok),
p AS (SELECT a.r AS x, b.r AS y FROM n a JOIN n b ON a.label = b.label AND a.d = b.d AND a.r <> b.r WHERE list_dot_product(a.u, b.u) >= 0.93),
w AS (SELECT r AS x, r AS y FROM v UNION SELECT w.x, p.y FROM w JOIN p ON p.x = w.y),
c AS (SELECT w.x AS r, min(v.vec_id) AS component_id FROM w JOIN v ON v.r = w.y GROUP BY 1), l AS (SELECT x AS r, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v JOIN c USING (r) LEFT JOIN l USING (r)"""

#: Word sets of lines, joined where words of their prefixes by rarity meet, and their Jaccard similarity; n is a line's place among all.
_LINES = """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT r, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
s AS (SELECT r, i, row_number() OVER (ORDER BY r, i) AS n, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+'))) AS ws FROM x),
u AS (SELECT ws, min(n) AS n, len(ws) AS k FROM s WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT n, k, unnest(ws) AS w FROM u), f AS (SELECT w, count(*) AS c FROM t GROUP BY 1),
o AS (SELECT n, k, w, row_number() OVER (PARTITION BY n ORDER BY c, w) AS p FROM t JOIN f USING (w)),
q AS (SELECT n, k, w FROM o WHERE p <= k - ceil(0.8 * k - 1e-9) + 1),
m AS (SELECT DISTINCT a.n AS a, b.n AS b FROM q a JOIN q b ON a.w = b.w AND a.n < b.n AND least(a.k, b.k) >= 0.8 * greatest(a.k, b.k) - 1e-9),
z AS (SELECT DISTINCT m.b AS n FROM m JOIN u a ON a.n = m.a JOIN u b ON b.n = m.b, (SELECT 1) WHERE len(list_intersect(a.ws, b.ws)) >= 0.8 * (a.k + b.k - len(list_intersect(a.ws, b.ws))) - 1e-9),
g AS (SELECT s.r, s.i FROM s JOIN u USING (ws) WHERE s.n > u.n UNION SELECT s.r, s.i FROM s JOIN z USING (n))
SELECT d.doc_id, len(d.ls)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed, coalesce(string_agg(g.i::VARCHAR, ',' ORDER BY g.i), '') AS removed FROM d LEFT JOIN g ON g.r = d.r GROUP BY d.r, d.doc_id, d.ls"""

#: The others have no SQL: tokenizers, 64-bit hashes, fits, random draws, transducers, MinHash and images; tests hold them against brute force.
ORACLES: dict[str, str] = {"op4_embeddings": _EMBEDDINGS, "op7_lines": _LINES}
