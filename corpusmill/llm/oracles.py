"""The queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

ORACLES = {
    "op5_url_filters": r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS sep FROM pages
), split AS (
  SELECT page_id,
    CASE WHEN sep = 0 THEN '' ELSE translate(regexp_extract(substr(u, sep + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN sep = 0 THEN '' ELSE regexp_extract(substr(u, sep + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM parts
), rules(rule, h, p, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fit AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fit f USING (page_id)
""",
    "op8_benchmark_decontamination": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT item, least(len(ws), 10) AS n, ws, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS i
  FROM b WHERE len(ws) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM bw
), lens AS (SELECT DISTINCT n FROM win), dw AS (
  SELECT doc_id, n, ws, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, lens WHERE len(ws) >= n
), hit AS (
  SELECT d.doc_id, d.i, d.n, win.item FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM dw) d
  JOIN win ON d.win = win.win AND d.n = win.n
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1
)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat('mix:', coalesce(cast(doc_id AS VARCHAR), ''))) AS k FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), s AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(source_size) OVER () * 1.5 AS budget FROM p
), r AS (
  SELECT *, row_number() OVER (ORDER BY source_size / w, place) AS k,
    coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY source_size / w DESC, place DESC) AS open_w FROM s
), l AS (
  SELECT arg_min((budget::DOUBLE - capped) / open_w, k) AS level FROM r
  WHERE (budget::DOUBLE - capped) / open_w * w <= 2 * source_size
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, level * w) AS target FROM s, l
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN target - whole * source_size > 0
  AND before + size::DOUBLE / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM q
""",
    "op7_quality_rules": r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), g AS (
  SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)
), f AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f) GROUP BY 1
), m AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(word_chars, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 10 * word_chars // greatest(n_words, 1) AS word_length FROM m
), w AS (
  UNPIVOT (SELECT doc_id, lang, source, symbols, dup_lines, repeats, word_length FROM b WHERE NOT base_failed)
  ON symbols, dup_lines, repeats, word_length INTO NAME measure VALUE whole
), u AS (
  SELECT doc_id, lang, source, measure, whole - whole % cast(10 ** (greatest(len(cast(whole AS VARCHAR)), 3) - 3) AS BIGINT) AS v FROM w
), lv AS (
  SELECT 0 AS level, lang, source, measure, v FROM u
  UNION ALL SELECT 1, lang, NULL, measure, v FROM u UNION ALL SELECT 2, NULL, NULL, measure, v FROM u
), q AS (
  SELECT level, lang, source, measure, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM lv GROUP BY ALL
), lim AS (
  SELECT *, q1 - 3 * greatest(q3 - q1, CASE measure WHEN 'symbols' THEN 10 WHEN 'dup_lines' THEN 120 WHEN 'repeats' THEN 160 ELSE 15 END) AS low,
    q3 + 3 * greatest(q3 - q1, CASE measure WHEN 'symbols' THEN 10 WHEN 'dup_lines' THEN 120 WHEN 'repeats' THEN 160 ELSE 15 END) AS high FROM q
), bad AS (
  SELECT DISTINCT doc_id FROM (
    SELECT u.doc_id, u.v, l.low, l.high FROM u JOIN lim l ON u.measure = l.measure
      AND (l.level = 2 OR u.lang IS NOT DISTINCT FROM l.lang) AND (l.level > 0 OR u.source IS NOT DISTINCT FROM l.source)
    WHERE l.n >= 100 OR l.level = 2
    QUALIFY row_number() OVER (PARTITION BY u.doc_id, u.measure ORDER BY l.level) = 1
  ) WHERE v NOT BETWEEN low AND high
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.doc_id IS NULL AS kept FROM b LEFT JOIN bad USING (doc_id)
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE crc_in AS (
  SELECT DISTINCT doc_id, cast(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL
), crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(s, ''),
      lambda c: [1000 + ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y - 1000) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT) AS crc
  FROM crc_in
), d AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS grp, n_chars,
    coalesce(strlen(cast(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents
), leaves AS (
  SELECT d.doc_id, grp, sha256(head || coalesce(strlen(cast(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen(cast(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered
  FROM d LEFT JOIN crc USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), low(grp, lvl, pos, digest, n) AS (
  SELECT grp, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT grp, max(lvl) + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 1) // 2) FROM low WHERE n > 1 GROUP BY grp, pos // 2
), tops AS (
  SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high(lvl, pos, digest, n) AS (
  SELECT 0, pos, digest, n FROM tops
  UNION ALL
  SELECT max(lvl) + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 1) // 2) FROM high WHERE n > 1 GROUP BY pos // 2
), steps AS (
  SELECT p.grp, p.pos, l.lvl, l.pos % 2 = 1 AS is_right, s.digest AS sibling FROM placed p
  JOIN low l ON l.grp = p.grp AND l.pos = p.pos >> l.lvl AND l.n > 1
  LEFT JOIN low s ON s.grp = l.grp AND s.lvl = l.lvl AND s.pos = xor(l.pos, 1)
  UNION ALL
  SELECT p.grp, p.pos, 1000 + h.lvl, h.pos % 2 = 1, s.digest FROM placed p JOIN tops t ON t.grp = p.grp
  JOIN high h ON h.pos = t.pos >> h.lvl AND h.n > 1 LEFT JOIN high s ON s.lvl = h.lvl AND s.pos = xor(h.pos, 1)
), proofs AS (
  SELECT grp, pos, string_agg(coalesce(sibling, ''), '' ORDER BY lvl) AS joined, list({'r': is_right, 's': coalesce(sibling, '')} ORDER BY lvl) AS path
  FROM steps GROUP BY grp, pos
), fold AS (
  SELECT p.doc_id, p.grp, p.pos, p.leaf, coalesce(joined, '') AS joined, path, 0 AS i, coalesce(tampered, leaf) AS acc FROM placed p LEFT JOIN proofs q USING (grp, pos)
  UNION ALL
  SELECT doc_id, grp, pos, leaf, joined, path, i + 1, sha256(CASE WHEN path[i + 1].r THEN path[i + 1].s || acc ELSE acc || path[i + 1].s END) FROM fold WHERE i < len(path)
)
SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, sha256(joined) AS proof_sha256, acc AS folded_root, acc = r.digest AS verified
FROM fold f JOIN tops t ON t.grp = f.grp, (SELECT digest FROM high WHERE n = 1) r WHERE i = coalesce(len(path), 0)
""",
    "op12_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(cast(conv_id AS VARCHAR), ''),
      lambda c: [1000 + ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y - 1000) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), built AS (
  SELECT conv_id, 0 AS part, t.place, t.role, t.text FROM crc JOIN (SELECT conv_id AS base, place, role, text FROM turns) t ON t.base = conv_id - conv_id % 20 AND t.place <= h
  UNION ALL
  SELECT conv_id, 1, place, role, text FROM turns JOIN crc USING (conv_id) WHERE place > h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, role, text FROM built
), prefixes AS (
  SELECT conv_id, 0 AS depth, ''::VARCHAR AS name, NULL AS parent, 0 AS words FROM crc
  UNION ALL
  SELECT p.conv_id, p.depth, string_agg(strlen(q.role) || ':' || q.role || strlen(q.text) || ':' || q.text, '' ORDER BY q.depth),
    coalesce(string_agg(strlen(q.role) || ':' || q.role || strlen(q.text) || ':' || q.text, '' ORDER BY q.depth) FILTER (WHERE q.depth < p.depth), ''),
    max(len(regexp_extract_all(p.text, '[^\x20\x09-\x0D]+')))
  FROM placed p JOIN placed q ON q.conv_id = p.conv_id AND q.depth <= p.depth GROUP BY p.conv_id, p.depth
), lengths AS (
  SELECT conv_id, max(depth) AS len FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT name, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    coalesce(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = len), '') AS ends
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY name, depth
), kids AS (
  SELECT parent AS name, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), sums AS (
  SELECT a.name, a.depth, sum(d.saved) AS saved, count(*) FILTER (WHERE k.name IS NULL) AS n_leaves
  FROM nodes d LEFT JOIN kids k ON k.name = d.name JOIN prefixes p ON p.conv_id = d.conv_id AND p.depth <= d.depth
  JOIN nodes a ON a.name = p.name AND a.depth = p.depth GROUP BY a.name, a.depth
)
SELECT n.conv_id, cast(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
  cast(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.name = n.name AND s.depth = n.depth LEFT JOIN kids k ON k.name = n.name LEFT JOIN nodes u ON n.depth > 0 AND u.name = n.parent AND u.depth = n.depth - 1
""",
}
