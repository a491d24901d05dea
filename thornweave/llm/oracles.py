"""SQL for what SQL can express."""

from .quality import BOILERPLATE

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range(0, 20) t(k)),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE g.p IS NULL) AS kept
  FROM places LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM again),
repeats AS (SELECT doc_id, sum(n)::BIGINT AS n FROM gaps GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line FROM w),
counted AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS ink,
    len(regexp_extract_all(line, '[|›»•·]|\x20>\x20')) AS separators, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '\p{L}')) AS letters
  FROM lines
),
inked AS (SELECT * FROM counted WHERE n > 0),
stays AS (
  SELECT doc_id, sum(ink) AS ink FROM inked
  WHERE NOT (
    (n > 12 AND NOT regexp_matches(line, '[.!?…。！？]'))
    OR (line = upper(line) AND line <> lower(line) AND letters >= 20)
    OR (separators >= 3 AND separators * 100 >= n * 20)
    OR symbols * 100 > ink * 10
    OR (n <= 30 AND regexp_matches(lower(line), '\b(?:@PHRASES@)'))
  ) GROUP BY doc_id
),
dups AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM inked GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(stays.ink, 0) AS ink
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN stays USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND ink * 100 >= word_chars * 50 AS kept
FROM base
"""

QUALITY = QUALITY.replace("@PHRASES@", "|".join(BOILERPLATE).replace("'", "''"))

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS size, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
wanted AS (SELECT item_id, len(w) AS n, array_to_string(w[o:o + 4], ' ') AS g, count(*) AS c FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS o FROM i WHERE len(w) >= 5) GROUP BY ALL),
met AS (SELECT doc_id, item_id, size, n, c, p, g FROM ds JOIN wanted USING (g)),
held AS (
  SELECT doc_id, item_id, start, g, count(*) AS k, any_value(c) AS c, any_value(least(n, size)) - 4 AS a, any_value(n) - 4 AS b
  FROM (SELECT *, unnest(range(greatest(0, p - (n - 4)), least(p - 1, greatest(0, size - n)) + 1)) AS start FROM met) GROUP BY ALL
),
shared AS (SELECT doc_id, item_id, start, any_value(a) AS a, any_value(b) AS b, sum(least(k, c)) AS s FROM held GROUP BY ALL)
SELECT doc_id, item_id, start::BIGINT AS start, round(s / (a + b - s), 6) AS similarity FROM shared
WHERE s / (a + b - s) >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s / (a + b - s) DESC, start) = 1
"""

URLS = r"""
WITH RECURSIVE cut AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parted AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, lower(rest) AS low FROM cut),
told AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parted
),
page AS (
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said,
    CASE WHEN host = '' THEN [] ELSE list_distinct(
      list_transform(list_filter(string_split(regexp_extract(low, '^[^/?#]*'), '.'), lambda x: x <> ''), lambda x: 'host:' || x)
      || list_transform(list_filter(regexp_split_to_array(regexp_extract(low, '^[^/?#]*([^?#]*)', 1), '[/._-]'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '0', 'g'))
      || list_transform(list_filter(string_split(regexp_extract(low, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query:' || regexp_replace(regexp_extract(x, '^[^=]*'), '[0-9]+', '0', 'g'))
      || CASE WHEN contains(low, '#') THEN ['fragment:'] ELSE [] END) END AS held FROM told
),
marks AS (SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
known AS (SELECT row_number() OVER () AS k, held, coalesce(said = 'block', bad) AS bad FROM page LEFT JOIN marks ON doc_id = page_id WHERE len(held) > 0 AND coalesce(said = 'block', bad) IS NOT NULL),
least AS (SELECT ceil(greatest(0.002 * count(*), 20) - 1e-6) AS n FROM known),
token AS (
  SELECT token, list(k) AS ks, list(k) FILTER (WHERE bad) AS bad FROM (SELECT k, bad, unnest(held) AS token FROM known) GROUP BY 1 HAVING count(*) FILTER (WHERE bad) >= (SELECT n FROM least)
),
open_ AS (SELECT * FROM token WHERE len(bad) / len(ks) < 0.6),
sets AS (
  SELECT [token] AS s, token AS last, ks, bad FROM open_
  UNION ALL
  SELECT list_append(s, t.token), t.token, list_intersect(x.ks, t.ks), list_intersect(x.bad, t.bad) FROM sets x JOIN open_ t ON t.token > x.last
  WHERE len(list_intersect(x.bad, t.bad)) >= (SELECT n FROM least) AND len(x.bad) / len(x.ks) < 0.6
),
rules AS (SELECT s, len(bad) / len(ks) AS confidence FROM sets WHERE len(bad) / len(ks) >= 0.6 UNION ALL SELECT [token], len(bad) / len(ks) FROM token WHERE len(bad) / len(ks) >= 0.6),
fewest AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules x WHERE len(x.s) < len(r.s) AND list_has_all(r.s, x.s))),
met AS (SELECT DISTINCT held, array_to_string(s, ' ') AS mined, confidence FROM (SELECT DISTINCT held FROM page) JOIN fewest ON list_has_all(held, s)),
best AS (SELECT held, mined FROM met QUALIFY row_number() OVER (PARTITION BY held ORDER BY confidence DESC, mined) = 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN mined IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN rule IS NULL THEN mined END AS mined
FROM page LEFT JOIN best USING (held)
"""
