"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES = {
    "op3_url_filters": r"""
WITH hosts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         1704067200 + (page_id * 7919) % 2592000 AS t FROM pages),
entries AS (
  SELECT e.event_type AS category,
         CASE WHEN e.event_id % 5 = 0 AND len(string_split(h.host, '.')) > 2 THEN regexp_replace(h.host, '^[^.]*\.', '') ELSE h.host END AS pattern,
         CASE WHEN e.event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS action, CAST(floor(epoch(e.ts)) AS BIGINT) AS since, e.event_id AS seq
  FROM events e JOIN hosts h ON h.page_id = e.user_id
  WHERE e.event_type IS NOT NULL AND e.ts IS NOT NULL),
last_of AS (
  SELECT category, pattern, action, since FROM (
    SELECT *, row_number() OVER (PARTITION BY category, pattern, since ORDER BY seq DESC, action DESC) AS k FROM entries) WHERE k = 1),
held AS (
  SELECT * FROM (SELECT category, pattern, action, since, lead(since) OVER (PARTITION BY category, pattern ORDER BY since) AS until FROM last_of) WHERE action = 'add'),
found AS (
  SELECT h.page_id, e.category, e.pattern FROM hosts h JOIN held e
    ON (h.host = e.pattern OR h.host LIKE '%.' || e.pattern) AND e.pattern LIKE '%.%' AND e.since <= h.t AND (e.until IS NULL OR h.t < e.until))
SELECT h.page_id, count(f.category) AS n_active,
       coalesce(string_agg(DISTINCT f.category, ',' ORDER BY f.category), '') AS categories,
       coalesce((SELECT g.pattern FROM found g WHERE g.page_id = h.page_id ORDER BY length(g.pattern) DESC, g.pattern DESC LIMIT 1), '') AS pattern
FROM hosts h LEFT JOIN found f ON f.page_id = h.page_id GROUP BY h.page_id
""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sized AS (SELECT d, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
postings AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS term FROM sized) GROUP BY d, term),
weights AS (
  SELECT term, floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), totals),
items AS (
  SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
scores AS (
  SELECT i.item_id, i.text, s.d, any_value(s.doc_id) AS doc_id,
         sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * s.n * t.big_n) // t.big_l))))::BIGINT AS score
  FROM items i JOIN postings p USING (term) JOIN weights w USING (term) JOIN sized s ON s.d = p.d, totals t
  GROUP BY i.item_id, i.text, s.d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
""",
    "op12_collocations": r"""
WITH cleaned AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM cleaned),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces WHERE regexp_matches(piece, '[^\x20\x09]')),
counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM lists
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) FROM lists)
  GROUP BY lang, k, phrase),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT t.lang, t.k, t.phrase, t.a, t.c, x.f AS l, y.f AS r, ((1000000::HUGEINT * t.a * t.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts t JOIN counts x ON x.lang = t.lang AND x.phrase = array_to_string(t.w[1:t.c], ' ') AND x.k = t.c
  JOIN counts y ON y.lang = t.lang AND y.phrase = array_to_string(t.w[t.c+1:t.k], ' ') AND y.k = t.k - t.c),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS i FROM scored) WHERE i = 1),
inner_pairs AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT s.* FROM weakest s LEFT JOIN inner_pairs i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, z.n, r.score FROM ranked r JOIN sizes z ON z.lang = r.lang WHERE r.rank <= 2000
""",
}
