"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Written rules, then rules of up to three tokens counted by brute force; tests have longer ones.
_OP4 = rf"""
WITH split AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM split
), parsed AS (
  SELECT page_id, url, translate(h0, '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path
  FROM hosts
), tokens AS (
  SELECT *, list_distinct(list_concat(
    list_transform(list_filter(regexp_split_to_array(host, '[^0-9A-Za-z]+'), lambda t: t <> ''), lambda t: 'h:' || t),
    list_transform(list_filter(regexp_split_to_array(path, '[^0-9A-Za-z]+'), lambda t: t <> ''), lambda t: 'p:' || t)
  )) AS ts FROM parsed
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), labelled AS (
  SELECT row_number() OVER () AS r, ts, m.bad FROM tokens t JOIN marks m ON t.page_id = m.doc_id
), least AS (
  SELECT greatest(0.0005, 5.0 / count(*)) * count(*) AS n FROM labelled
), flat AS (
  SELECT r, bad, unnest(ts) AS t FROM labelled
), live AS (
  SELECT t, count(*) AS n, sum(bad) AS k FROM flat, least GROUP BY t HAVING sum(bad) >= ceil(any_value(least.n) - 1e-9)
), kept AS (
  SELECT r, bad, t FROM flat JOIN live USING (t)
), found AS (
  SELECT [t] AS rule, n, k FROM live
  UNION ALL SELECT [x.t, y.t], count(*), sum(x.bad) FROM kept x JOIN kept y ON x.r = y.r AND x.t < y.t GROUP BY x.t, y.t
  UNION ALL SELECT [x.t, y.t, z.t], count(*), sum(x.bad) FROM kept x JOIN kept y ON x.r = y.r AND x.t < y.t JOIN kept z ON y.r = z.r AND y.t < z.t GROUP BY x.t, y.t, z.t
), rules AS (
  SELECT rule FROM found, least WHERE k >= ceil(least.n - 1e-9) AND k >= 0.9 * found.n
), hit AS (
  SELECT DISTINCT url FROM tokens, rules WHERE list_has_all(ts, rule)
)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, r.rule, coalesce(r.verdict, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule_name
  FROM parsed
) p
LEFT JOIN (VALUES ('example.com/en/7', 'allow'), ('example.net/de/8', 'block'), ('com/en/', 'block'), ('net/de/', 'block'), ('org/es/', 'block')) r(rule, verdict)
  ON p.rule_name = r.rule
LEFT JOIN hit ON p.url = hit.url
"""

#: Water filling in closed form; the excess of capped sources goes to the rest by weight. A schedule is two
#: straight lines over half of the time each, so its integral is inverted by a quadratic on either half.
_OP8 = r"""
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(md5(text), '')) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sized GROUP BY source
), caps AS (
  SELECT *, (source_size * 3)::DOUBLE AS cap, (1 + rk % 3)::DOUBLE AS w, CASE rk % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END AS early FROM sources
), levels AS (
  SELECT *,
    sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM caps
), firsts AS (
  SELECT cap / w AS ratio, rk, rest, open FROM levels WHERE rest * w <= cap * open ORDER BY 1, 2 LIMIT 1
), goals AS (
  SELECT l.source, l.source_size, l.w, l.w * l.early AS k0, l.w * (2 - l.early) AS k2,
    CASE WHEN l.cap / l.w < f.ratio OR (l.cap / l.w = f.ratio AND l.rk < f.rk) THEN l.cap ELSE f.rest * l.w / f.open END AS target
  FROM levels l, firsts f
), streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized
), counted AS (
  SELECT s.doc_id, s.size, s.before, g.*,
    CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size)::BIGINT ELSE 0 END
      + CASE WHEN g.source_size > 0 AND floor(g.target / g.source_size) < 3
               AND s.before + s.size / 2.0 <= g.target - floor(g.target / g.source_size) * g.source_size THEN 1 ELSE 0 END AS copies
  FROM streams s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), asked AS (
  SELECT *, w * least(1.0, (before + size / 2.0) / greatest(target, 1)) AS y0,
            w * least(1.0, ((copies - 1) * source_size + before + size / 2.0) / greatest(target, 1)) AS y1 FROM counted
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(CASE WHEN y0 < (k0 + w) / 4 THEN 2 * y0 / (k0 + sqrt(greatest(0, k0 * k0 + 4 * (w - k0) * y0)))
    ELSE 0.5 + 2 * (y0 - (k0 + w) / 4) / (w + sqrt(greatest(0, w * w + 4 * (k2 - w) * (y0 - (k0 + w) / 4)))) END, 9) END AS position,
  CASE WHEN copies > 0 THEN round(CASE WHEN y1 < (k0 + w) / 4 THEN 2 * y1 / (k0 + sqrt(greatest(0, k0 * k0 + 4 * (w - k0) * y1)))
    ELSE 0.5 + 2 * (y1 - (k0 + w) / 4) / (w + sqrt(greatest(0, w * w + 4 * (k2 - w) * (y1 - (k0 + w) / 4)))) END, 9) END AS last_position
FROM asked
"""

#: Every window of every item against every window of the same length of every document.
_OP9 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), items AS (
  SELECT item_id, least(10, len(w)) AS k, w FROM b WHERE len(w) > 0 AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), sizes AS (
  SELECT DISTINCT k FROM windows
), places AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
), hits AS (
  SELECT p.r, p.i, p.k, v.item_id FROM places p JOIN windows v ON p.s = v.s AND p.k = v.k
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hits) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.r = c.r LEFT JOIN named m ON d.r = m.r
"""

#: Every kept term of a language against every pair of its sources, counts of 0 and all.
_OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3
), sizes AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM words w SEMI JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT e.lang, e.source, e.term, e.n, 1 + (1000000000::HUGEINT * (e.n + 1)) // (sum(e.n) OVER (PARTITION BY e.lang, e.source) + s.v) AS p,
         1 + (1000000000::HUGEINT * (e.lang_n + 1)) // (s.n + s.v) AS q
  FROM dense e JOIN sizes s ON e.lang = s.lang
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS f
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
) WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": _OP4,
    "op8_curriculum_mix": _OP8,
    "op9_decontamination": _OP9,
    "op11_source_divergence": _OP11,
}
