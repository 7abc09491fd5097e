"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
m AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]', '', 'g'))
    OR 5 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
    OR 2 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < word_chars) AS kept
FROM b
"""

OP8 = """
WITH rules(rule, host, path, action) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
f AS (SELECT c.page_id, c.host, c.path, (
        SELECT arg_max(r.rule, length(r.rule)) FROM rules r
        WHERE (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)) AS rule
      FROM c)
SELECT page_id, f.host, f.path, rule, coalesce((SELECT action FROM rules r WHERE r.rule = f.rule), 'allow') AS verdict FROM f
"""

# All phrases and their counts are built in full; candidates, cuts and covers follow the words of the contract.
OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
q AS (SELECT lang, row_number() OVER () AS q, piece FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
l AS (SELECT lang, q, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM q),
w AS (SELECT lang, q, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM l),
x AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY q ORDER BY i)),
g AS (SELECT lang, 1 AS m, w AS g FROM x UNION ALL SELECT lang, 2, w || ' ' || w2 FROM x WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM x WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM x WHERE w4 IS NOT NULL),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, string_split(g, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 30),
cov AS (SELECT lang, s, max(a) AS cover FROM (
          SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
            SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS i FROM c, (VALUES (2), (3)) AS t(k) WHERE k < m)) GROUP BY lang, s),
kept AS (SELECT c.* FROM c LEFT JOIN cov ON c.lang = cov.lang AND c.g = cov.s WHERE NOT coalesce(100 * cover::HUGEINT >= 80 * a::HUGEINT, FALSE)),
cut AS (SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS g1, array_to_string(w[k + 1:m], ' ') AS g2 FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
s AS (SELECT cut.lang, cut.g, cut.a, cut.k, y.f AS l, z.f AS r, (2000000 * cut.a::HUGEINT) // (y.f::HUGEINT + z.f::HUGEINT) AS score
      FROM cut JOIN f y ON y.lang = cut.lang AND y.g = cut.g1 JOIN f z ON z.lang = cut.lang AND z.g = cut.g2),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, g AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op2_quality_rules": OP2, "op8_url_filters": OP8, "op12_phrase_collocations": OP12}
