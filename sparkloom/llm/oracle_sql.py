"""SQL for the queries of this subpackage that SQL can express."""

MIXING = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (k - 1) % 3] AS DOUBLE) AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, k) AS j FROM w),
l AS (SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
      FROM o WINDOW before AS (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(j) AS j, arg_min(level, j) AS level FROM l WHERE level <= 3 * n / w),
t AS (SELECT source, n, CASE WHEN f.j IS NULL OR l.j < f.j THEN 3e0 * n ELSE least(3e0 * n, f.level * w) END AS target FROM l CROSS JOIN f),
q AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // n END AS passes, CASE WHEN n = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) % n END AS due FROM t),
a AS (SELECT d.*, n, target, passes, due, row_number() OVER () AS i, CASE WHEN sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= due THEN 1 ELSE 0 END AS more
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
-- what is left of a source's last pass goes, one document a step, to the largest undrawn one that fits
step AS (SELECT source, CAST(max(due) - sum(size * more) AS BIGINT) AS room, CAST([] AS BIGINT[]) AS picks FROM a GROUP BY source
  UNION ALL
  SELECT source, any_value(room) - arg_min(size, rank), list_append(any_value(picks), arg_min(i, rank)) FROM (
    SELECT s.source, s.room, s.picks, a.size, a.i, {'s': -size, 'd': draw, 'j': doc_id} AS rank
    FROM step s JOIN a ON a.source IS NOT DISTINCT FROM s.source AND a.more = 0 AND a.size BETWEEN 1 AND s.room AND NOT list_contains(s.picks, a.i)) GROUP BY source),
picked AS (SELECT unnest(arg_max(picks, len(picks))) AS i, 1 AS extra FROM step GROUP BY source)
SELECT doc_id, size, n AS source_size, target, CAST(size * (passes + more + coalesce(extra, 0)) AS BIGINT) AS taken FROM a LEFT JOIN picked USING (i)
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS hx,
      array_to_string(list_transform(string_split(sha1(h), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hx, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
      + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""

URLS = r"""
WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
link AS (
  SELECT url AS base, host, path, trim(regexp_replace(x, '^["'']|["'']$', '', 'g')) AS link FROM (
    SELECT url, host, path, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b[^>]*>')), '(?is)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) AS x FROM p
    UNION ALL
    SELECT url, host, path, regexp_extract(regexp_replace(regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>')), '(?is)\bcontent\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g'), '(?is)\burl\s*=\s*(.*)$', 1) AS x FROM p)
  WHERE contains(url, '://')),
target AS (SELECT base, CASE WHEN l = '' THEN NULL WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN starts_with(l, '//') THEN split_part(base, '://', 1) || ':' || l
    WHEN starts_with(l, '/') THEN split_part(base, '://', 1) || '://' || host || l WHEN starts_with(l, '?') THEN split_part(base, '://', 1) || '://' || host || path || l WHEN starts_with(l, '#') THEN base
    ELSE split_part(base, '://', 1) || '://' || host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || l END AS target
  FROM (SELECT *, replace(link, '&amp;', '&') AS l FROM link)),
every_url AS (SELECT url FROM pages WHERE contains(url, '://') UNION SELECT target FROM target WHERE contains(target, '://')),
keyed AS (SELECT url, translate(split_part(url, '://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE WHEN regexp_extract(r, '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(r, '^[^/?#]*([^?#]*)', 1) END || regexp_extract(r, '^[^?#]*(\?[^#]*)', 1) AS node
  FROM (SELECT url, substr(url, strpos(url, '://') + 3) AS r FROM every_url)),
edge AS (SELECT a.node AS a, b.node AS b FROM target JOIN keyed a ON a.url = base JOIN keyed b ON b.url = target WHERE a.node <> b.node),
sides AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a AS node, a AS other FROM sides UNION SELECT r.node, s.b FROM reach r JOIN sides s ON s.a = r.other),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
site AS (SELECT node, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT node, substr(node, strpos(node, '://') + 3) AS r FROM (SELECT DISTINCT node FROM keyed))),
rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS t(verdict, h, prefix)),
own AS (SELECT DISTINCT node, first_value(verdict) OVER (PARTITION BY node ORDER BY length(h || prefix) DESC) AS verdict FROM site JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix)),
said AS (SELECT coalesce(root.root, own.node) AS root, bool_or(verdict = 'allow') AS allowed FROM own LEFT JOIN root ON root.node = own.node GROUP BY 1),
mine AS (SELECT page_id, first_value(verdict) OVER w AS verdict, first_value(h || prefix) OVER w AS rule, row_number() OVER w AS i FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix)
  WINDOW w AS (PARTITION BY page_id ORDER BY length(h || prefix) DESC))
SELECT p.page_id, p.host, p.path, mine.rule, coalesce(mine.verdict, CASE WHEN said.allowed IS NULL OR said.allowed THEN 'allow' ELSE 'block' END) AS verdict, coalesce(root.root, keyed.node) AS alias_root
FROM p LEFT JOIN mine ON mine.page_id = p.page_id AND i = 1 LEFT JOIN keyed ON keyed.url = p.url LEFT JOIN root ON root.node = keyed.node LEFT JOIN said ON said.root = coalesce(root.root, keyed.node)
"""

PHRASES = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS f FROM x, range(1, 5) ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM g WHERE f >= 30),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
cut AS (SELECT lang, phrase, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail, f FROM c, range(1, 4) js(j) WHERE j < k),
part AS (SELECT cut.lang, cut.phrase, j, cut.f AS a, h.f AS l, t.f AS r, CAST(CAST(2000000 AS HUGEINT) * cut.f // (CAST(h.f AS HUGEINT) + t.f) AS BIGINT) AS score
  FROM cut JOIN often h ON h.lang = cut.lang AND h.phrase = head JOIN often t ON t.lang = cut.lang AND t.phrase = tail),
low AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS most FROM c, range(1, 4) it(i), range(2, 4) mt(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
ranked AS (SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, score
  FROM low LEFT JOIN held ON held.lang = low.lang AND held.phrase = low.phrase WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

PASSAGES = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM d),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM pos JOIN d USING (doc_id)),
hit AS (SELECT doc_id, i FROM x JOIN (SELECT s, min(doc_id) AS least FROM x GROUP BY s) m ON m.s = x.s WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(0, 13) js(j)),
lost AS (SELECT doc_id, list(i) AS lost FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(lost), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN lost IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(lost, z[2])), lambda z: z[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
