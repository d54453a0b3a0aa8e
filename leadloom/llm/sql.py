"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

_RULES = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"),
          ("net", "/fr/", "block"), ("com", "/", "allow")]  # longest first


def _case(value: str) -> str:
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value == 'rule' else v}'"
        for h, p, v in _RULES) + (" END" if value == "rule" else " ELSE 'allow' END")


OP1 = rf"""
WITH parts AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
SELECT page_id, host, path, {_case('rule')} AS rule, {_case('verdict')} AS verdict FROM parts"""

# Links from shared n-grams: the intersection is the number of n-grams that two documents both have.
OP2 = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS size, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-6),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION
        SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
copies AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY w) END AS copy_id FROM sets),
counts AS (SELECT l.x, count(*) AS n, count(DISTINCT c.copy_id) FILTER (c.copy_id <> o.copy_id) AS k
        FROM links l JOIN copies c ON l.y = c.doc_id JOIN copies o ON l.x = o.doc_id GROUP BY l.x)
SELECT d.doc_id, copy_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
       CAST(coalesce(k, 0) AS BIGINT) AS n_linked_classes, d.doc_id = class_id AS kept
FROM copies d JOIN class ON class.x = d.doc_id LEFT JOIN counts ON counts.x = d.doc_id"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
class AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN class ON class.x = vec_id LEFT JOIN counts ON counts.x = vec_id"""

OP10 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS keeper FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM k"""

OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(words) < 100 AS INT) AS a, CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) AS b,
    CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) AS c,
    CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d, CAST(coalesce(w.doc_id > first_id, false) AS INT) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT part, good, toxic, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n FROM m GROUP BY ALL),
orders AS (SELECT '' AS o UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f) WHERE NOT contains(o, f)),
steps AS (SELECT o, i AS step, substr(o, i, 1) AS letter, 1 << (ascii(substr(o, i, 1)) - 65) AS bit,
    CAST(list_sum([0] || list_transform(range(1, i), lambda k: 1 << (ascii(substr(o, k, 1)) - 65))) AS INT) AS before
  FROM orders, range(1, 6) AS r(i) WHERE length(o) = 5),
r AS (SELECT part, o AS filter_order, CAST(step AS INT) AS step, letter,
    CAST(sum(CASE WHEN (mask & (bit | before)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN (mask & bit) <> 0 AND (mask & before) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN good AND (mask & bit) <> 0 AND (mask & before) = 0 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN toxic AND (mask & bit) <> 0 AND (mask & before) = 0 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM x, steps GROUP BY part, o, step, letter)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""

# crc32 bit by bit; a node is its whole list of turns.
OP13 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS j FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY j) AS turns,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT),
      lambda crc, ch: list_reduce([xor(crc, ch)] || list_transform(range(8), lambda k: 0::BIGINT),
        lambda r, k: xor(r >> 1, 3988292384::BIGINT * (r & 1))))) % 4 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns FROM c LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d AS depth, turns[1:d] AS prefix, d = len(turns) AS ends FROM r, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(prefix[depth].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS words
  FROM p GROUP BY prefix, depth),
f AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN n AS u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.prefix = n.prefix[1:n.depth - 1]),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM f WHERE depth > 0 GROUP BY ALL),
a AS (SELECT f.*, coalesce(k.n, 0) AS n_children FROM f LEFT JOIN k ON k.conv_id = f.conv_id AND k.depth = f.depth),
s AS (SELECT p.depth, p.prefix AS prefix, count(*) FILTER (a.n_children = 0) AS n_leaves, sum((a.n_convs - 1) * a.words) AS saved_tokens
  FROM a, unnest(range(0, a.depth + 1)) AS u(d) JOIN (SELECT DISTINCT prefix, depth FROM n) AS p ON p.depth = u.d AND p.prefix = a.prefix[1:u.d] GROUP BY ALL)
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN s ON s.depth = a.depth AND s.prefix = a.prefix"""

# The given pages hold one article each and no constant text inside it, so this is what is left of it without its tags.
OP12 = r"""
WITH p AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<[^>]*>') AS parts FROM pages),
t AS (SELECT page_id, url, list_aggregate(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))),
    lambda x: x <> ''), 'string_agg', chr(10)) AS text FROM p)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM t"""
