"""SQL statements of the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

import re

from tidemark.llm.licenses import TEMPLATES, template_words

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_REACH = """, edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(n, m) AS (SELECT u, u FROM edges UNION SELECT reach.n, edges.v FROM reach JOIN edges ON edges.u = reach.m),
least AS (SELECT n, min(m) AS c FROM reach GROUP BY n)
"""

EXTRACTION = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""

NEIGHBOURS = (
    """WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93)"""
    + _REACH
    + """SELECT e.vec_id, CAST(count(edges.v) AS BIGINT) AS n_links, coalesce(any_value(c), e.vec_id) AS component_id, coalesce(any_value(c), e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN edges ON edges.u = e.vec_id LEFT JOIN least ON least.n = e.vec_id GROUP BY e.vec_id"""
)

NEAR_DUPLICATES = (
    f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k))"""
    + _REACH
    + """SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.n = w.doc_id"""
)

_VALUES = ", ".join("('{}', '{}')".format(name, " ".join(template_words(text))) for name, text in TEMPLATES)
assert not re.search(r"[^A-Za-z0-9 (),.'-]", _VALUES)

LICENCES = rf"""
WITH t AS (SELECT name, string_split(words, ' ') AS w FROM (VALUES {_VALUES}) AS v(name, words)),
ts AS (SELECT DISTINCT name, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM t),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents WHERE regexp_matches(lower(text), 'licens|redistribut|permission|public domain')),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM d),
h AS (SELECT doc_id, ts.name, count(*) AS k FROM ds JOIN ts ON ts.s = ds.s GROUP BY 1, 2)
SELECT doc_id, h.name AS license_id, round(k / CAST(n AS DOUBLE), 6) AS containment FROM h JOIN tn ON tn.name = h.name WHERE k >= 0.8 * n
"""


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    raw = f"hex(encode({text}))"
    bits = f"list_transform(range(4 * length({raw})), lambda i: ((('0x' || substr({raw}, CAST(1 + 2 * (i // 8) AS BIGINT), 2))::BIGINT >> (i % 8)) & 1)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))))"


SPELLING = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
counted AS (SELECT doc || ':' || run AS k, run, count(*) AS n FROM lowered GROUP BY ALL),
drawn AS (SELECT run, n, CAST({_crc32("k")} AS BIGINT) AS h FROM counted),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM drawn),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM spots),
wild AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS s FROM spots),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM wild a JOIN wild b ON a.s = b.s AND a.word <> b.word
  UNION ALL SELECT c.word, c.n, v.word, v.n FROM cut c JOIN vocab v ON c.s = v.word
  UNION ALL SELECT v.word, v.n, c.word, c.n FROM cut c JOIN vocab v ON c.s = v.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.other END AS form, CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n FROM vocab v LEFT JOIN best b USING (word)),
chain(word, root) AS (SELECT word, word FROM formed UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""

PREFIXES = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, max(pos) AS n, CAST(conv_id AS VARCHAR) AS k, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
c AS (SELECT conv_id, n, base, {_crc32("k")} % 4 AS h FROM ids),
e AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS got FROM c LEFT JOIN ids b ON b.conv_id = c.base),
r AS (SELECT e.conv_id, t.pos AS depth, role, text FROM e JOIN t ON t.conv_id = e.base AND t.pos <= e.got
  UNION ALL SELECT e.conv_id, e.got + t.pos - e.h, role, text FROM e JOIN t ON t.conv_id = e.conv_id AND t.pos > e.h),
p AS (SELECT conv_id, depth, list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth) AS path, count(*) OVER (PARTITION BY conv_id) AS whole, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r),
m AS (SELECT conv_id, depth, min(conv_id) OVER g AS rep, count(*) OVER g AS n, words, depth = whole AS ends FROM p WINDOW g AS (PARTITION BY depth, path)
  UNION ALL SELECT conv_id, 0, min(conv_id) OVER (), count(*) OVER (), 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
nodes AS (SELECT DISTINCT depth, rep, n, words FROM m),
parents AS (SELECT a.depth, a.rep, b.rep AS parent FROM nodes a LEFT JOIN m b ON b.conv_id = a.rep AND b.depth = a.depth - 1),
children AS (SELECT depth - 1 AS depth, parent AS rep, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL),
own AS (SELECT a.*, coalesce(children.n, 0) AS n_children FROM nodes a LEFT JOIN children USING (depth, rep)),
sums AS (SELECT b.depth, b.rep, sum(CASE WHEN a.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((a.n - 1) * a.words) AS saved FROM own a JOIN m b ON b.conv_id = a.rep AND b.depth <= a.depth GROUP BY ALL),
ended AS (SELECT depth, rep, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m WHERE ends GROUP BY ALL)
SELECT own.rep AS conv_id, CAST(own.depth AS BIGINT) AS depth, parents.parent AS parent_conv_id, own.n AS n_convs, own.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN parents USING (depth, rep) JOIN sums USING (depth, rep) LEFT JOIN ended USING (depth, rep)
"""

ARCHIVE = """
WITH a AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
b AS (SELECT page_id, octet_length(p) AS n, sha1(p) AS d, max(page_id) OVER (PARTITION BY p) AS top FROM a)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM b
"""
