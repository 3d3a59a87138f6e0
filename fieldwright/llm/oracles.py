"""SQL twins of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({text}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1 = f"""
WITH i AS (SELECT item_id, {_WORDS.format(text=_LOWER)} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)
),
d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
dk AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
dw AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS p
  FROM dk CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE k + n - 1 <= len(w)
),
h AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.p = iw.p),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_WS = "[ \\t\\n\\x0B\\f\\r]"
OP5 = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
),
win AS (SELECT doc_id, k, array_to_string(w[k : k + 7], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d)),
rep AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, p) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS x FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, host, trim(regexp_replace(lower(x), '{_WS}+', ' ', 'g'), ' ') AS x FROM (SELECT doc_id, host, unnest(l) AS x FROM d)),
often AS (SELECT host, x, min(doc_id) AS first FROM ln GROUP BY host, x HAVING count(DISTINCT doc_id) > 20),
gone AS (
  SELECT ln.doc_id, sum(len(string_split(ln.x, ' '))) AS n FROM ln JOIN often USING (host, x) WHERE ln.doc_id <> often.first GROUP BY ln.doc_id
),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 20 OR 100 * (n_words - n_removed_words) < 20 * n_words)) AS kept,
       n_removed_words
FROM f
"""

OP7 = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 2)) END) AS k FROM d)
),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * p.c >= 80 * (x.c + y.c - p.c))
, r AS (SELECT doc_id FROM n)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, coalesce(k.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (
  WITH RECURSIVE reach(a, b) AS (SELECT u, v FROM e UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u)
  SELECT a AS doc_id, least(a, min(b)) AS root FROM reach GROUP BY a
) k USING (doc_id)
"""


OP11 = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
lg AS (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, v.term, v.c AS lc, coalesce(k.c, 0) AS c
      FROM g JOIN v USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL) k
      ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
s AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n FROM c),
p AS (SELECT s.lang, source, term, c,
      CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // CAST(s.n + 5 * lg.v AS HUGEINT) AS BIGINT) AS p,
      CAST(1 + (CAST(1000000000 AS HUGEINT) * (lc + 5)) // CAST(lg.n + 5 * lg.v AS HUGEINT) AS BIGINT) AS q FROM s JOIN lg USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
      ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""

_CRC = "list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(CAST(conv_id AS VARCHAR), '')])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END)"
OP13 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, role, k) AS ks, list(b ORDER BY turn NULLS FIRST, role, k) AS bs FROM t GROUP BY conv_id),
h AS (SELECT *, conv_id - conv_id % 5 AS f, xor({_CRC}, 4294967295::BIGINT) % 9 AS h FROM own),
c AS (SELECT h.conv_id, coalesce(o.ks[1 : h.h], []) || h.ks[h.h + 1 :] AS ks, coalesce(o.bs[1 : h.h], []) || h.bs[h.h + 1 :] AS bs FROM h LEFT JOIN own o ON o.conv_id = h.f),
m AS (SELECT conv_id AS c, d, len(ks) AS n, array_to_string(ks[1 : d], '') AS p, array_to_string(ks[1 : d - 1], '') AS pp, coalesce(bs[d], 0) AS b
  FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM c)),
x AS (SELECT d, p, any_value(pp) AS pp, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS own, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends FROM m GROUP BY d, p),
y AS (SELECT x.*, u.conv_id AS parent_conv_id, coalesce(k.n, 0) AS n_children FROM x LEFT JOIN x u ON x.d > 0 AND u.d = x.d - 1 AND u.p = x.pp
  LEFT JOIN (SELECT d - 1 AS d, pp, count(*) AS n FROM x WHERE d > 0 GROUP BY ALL) k ON k.d = x.d AND k.pp = x.p),
s AS (SELECT a.d, a.p, sum(y.own) AS saved, count(*) FILTER (y.n_children = 0) AS leaves FROM y JOIN m a ON a.c = y.conv_id AND a.d <= y.d GROUP BY a.d, a.p)
SELECT conv_id, CAST(y.d AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM y JOIN s ON s.d = y.d AND s.p = y.p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op5_quality": OP5, "op7_ngram_join": OP7, "op11_divergence": OP11, "op13_conversation_trie": OP13}
