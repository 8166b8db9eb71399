"""SQL for DuckDB of the operators that SQL can express over whole small tables."""

from __future__ import annotations

from .substring_dedup import MIN_WORDS

UNITS = rf"""WITH l AS (SELECT doc_id, text, string_split(replace(regexp_replace(text, '([.!?]) ', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, text, l, unnest(range(1, len(l) + 1)) AS i FROM l),
p AS (SELECT doc_id, text, i - 1 AS piece, i = len(l) AS last, l[i] AS t, list_filter(string_split_regex(lower(l[i]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM i),
q AS (SELECT *, len(w) AS n, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY piece) AS upto,
  coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p),
v AS (SELECT * FROM q WHERE n > 0),
u AS (SELECT a.doc_id, a.piece, b.piece AS final FROM v a ASOF JOIN v b ON a.doc_id = b.doc_id AND a.upto - a.n + {MIN_WORDS} <= b.upto),
k AS (SELECT u.doc_id, u.piece, u.final, string_agg(array_to_string(v.w, ' '), ' ' ORDER BY v.piece) AS k FROM u JOIN v ON v.doc_id = u.doc_id AND v.piece BETWEEN u.piece AND u.final GROUP BY ALL),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, piece) > 1 AS gone FROM k) WHERE gone),
c AS (SELECT DISTINCT doc_id, unnest(range(piece, final + 1)) AS piece FROM d), b AS (SELECT DISTINCT doc_id, unnest(range(piece, final)) AS piece FROM d),
m AS (SELECT q.*, c.piece IS NOT NULL AS gone, b.piece IS NOT NULL AS joined FROM q LEFT JOIN c USING (doc_id, piece) LEFT JOIN b USING (doc_id, piece)),
o AS (SELECT *, gone AND NOT coalesce(lag(joined) OVER (PARTITION BY doc_id ORDER BY piece), false) AS opens, gone AND NOT joined AS closes FROM m),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY piece) AS span FROM o),
r AS (SELECT doc_id, span, min(start) FILTER (opens) AS a, max(start + length(t)) FILTER (closes) AS z FROM s WHERE gone GROUP BY doc_id, span),
x AS (SELECT doc_id, count(*) AS n_removed, sum(z - a)::BIGINT AS n_chars_removed, string_agg(a || '-' || z, ',' ORDER BY a) AS removed FROM r GROUP BY doc_id),
y AS (SELECT doc_id, coalesce(string_agg(CASE WHEN gone THEN '' ELSE t END || CASE WHEN joined OR last THEN '' ELSE substr(text, start + length(t) + 1, 1) END, '' ORDER BY piece), '') AS text FROM m GROUP BY doc_id)
SELECT doc_id, text, coalesce(n_removed, 0) AS n_removed, coalesce(n_chars_removed, 0) AS n_chars_removed, coalesce(removed, '') AS removed FROM y LEFT JOIN x USING (doc_id)
UNION ALL SELECT doc_id, NULL, 0, 0, '' FROM documents WHERE text IS NULL"""

_COMPONENTS = """reach AS (SELECT id AS node, id AS root FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN links e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)"""

EMBEDDINGS = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
{_COMPONENTS}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept FROM nodes JOIN roots ON node = id LEFT JOIN counts ON a = id"""

NGRAMS = f"""WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents), w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
{_COMPONENTS}
SELECT id AS doc_id, root AS class_id, coalesce(n, 0) AS n_links, id = root AS kept FROM nodes JOIN roots ON node = id LEFT JOIN counts ON a = id"""

LINES = """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, i - 1 AS line, l[i] AS t FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
k AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(lower(t), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS w FROM u),
d AS (SELECT w, min((doc_id, line)) AS first, len(w) AS n FROM k WHERE len(w) > 0 GROUP BY w),
tok AS (SELECT first, n, unnest(w) AS token FROM d), f AS (SELECT token, count(*) AS df FROM tok GROUP BY token),
p AS (SELECT first, n, token FROM (SELECT first, n, token, row_number() OVER (PARTITION BY first ORDER BY df, token) AS i FROM tok JOIN f USING (token)) WHERE i <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.first AS later, b.first AS earlier FROM p a JOIN p b ON a.token = b.token AND b.first < a.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
m AS (SELECT DISTINCT later FROM c JOIN d x ON x.first = later JOIN d y ON y.first = earlier WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
gone AS (SELECT k.doc_id, k.line FROM k JOIN d ON d.w = k.w WHERE (k.doc_id, k.line) > d.first OR d.first IN (SELECT later FROM m))
SELECT u.doc_id, coalesce(string_agg(t, chr(10) ORDER BY u.line) FILTER (gone.line IS NULL), '') AS text, count(gone.line) AS n_lines_removed
FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.line = u.line GROUP BY u.doc_id
UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL"""

ORACLES = {
    "op6_line_dedup": LINES,
    "op8_substring_dedup": UNITS,
    "op9_embedding_dedup": EMBEDDINGS,
    "op10_ngram_join": NGRAMS,
}
