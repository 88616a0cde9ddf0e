"""DuckDB SQL that gives the rows of a query by other means."""

#: Counts of each text, by splitting it into rows of words and of lines.
MEASURED = r"""
docs AS (SELECT doc_id, coalesce('=' || source, '-') AS host, coalesce(text, '') AS text FROM {documents}),
split AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS ls FROM docs),
lines AS (SELECT doc_id, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM split),
words AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, w FROM split WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM words),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows),
covered AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM seen WHERE n > 1),
repeats AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, d.host, len(s.w)::BIGINT AS n_words,
         length(regexp_replace(d.text, '[ \t\n\v\f\r]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         l.n_lines::BIGINT AS n_lines, l.n_dup_lines::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM docs d JOIN split s USING (doc_id) JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
ruled AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > word_chars AS symbols,
         10 * n_dup_lines > 3 * n_lines AS lines, word_chars > 15 * n_words AS length
  FROM measured),
long_rules AS (
  SELECT host, unnest(['short', 'repeats', 'symbols', 'lines', 'length']) AS rule,
         unnest([short::INT, repeats::INT, symbols::INT, lines::INT, length::INT]) AS f FROM ruled),
hosts AS (SELECT host, rule, count(*)::DOUBLE AS n, sum(f)::DOUBLE AS f FROM long_rules GROUP BY ALL),
totals AS (SELECT rule, sum(n) AS n, count(*) AS h, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS q FROM hosts GROUP BY rule),
varied AS (SELECT rule, n, m, q - m * m - m * (1 - m) * h / n AS v FROM totals),
priors AS (SELECT rule, m, CASE WHEN v > 0 THEN least(n, greatest(0, m * (1 - m) / v - 1)) ELSE n END AS s FROM varied),
verdicts AS (SELECT host, max((f + m * s) / (n + s)) > 0.5 AS rejected FROM hosts JOIN priors USING (rule) GROUP BY host)
"""

QUALITY = (
    "WITH "
    + MEASURED.replace("{documents}", "documents")
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       rejected AS host_rejected, NOT (short OR repeats) AND NOT rejected AS kept
FROM ruled JOIN verdicts USING (host)
"""
)

#: Every document laid over every item along every diagonal with an equal token.
CONTAMINATED = r"""
doc_words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM {documents}),
item_words AS (SELECT min(item_id) AS item_id, w, len(w) AS n FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) GROUP BY w),
doc_tokens AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM doc_words),
item_tokens AS (SELECT item_id, n, unnest(w) AS t, unnest(range(len(w))) AS q FROM item_words),
equal AS (SELECT doc_id, item_id, n, p - q AS diag, q FROM doc_tokens JOIN item_tokens USING (t)),
spans AS (SELECT doc_id, item_id, n, diag, lead(q, 9) OVER (PARTITION BY doc_id, item_id, diag ORDER BY q) - q AS span FROM equal),
diagonals AS (SELECT doc_id, item_id, n, diag, count(*) AS eq, coalesce(bool_or(span < 12), false) AS near FROM spans GROUP BY ALL),
found AS (SELECT doc_id, item_id, max(eq) AS eq FROM diagonals WHERE CASE WHEN n < 12 THEN eq = n ELSE near END GROUP BY ALL),
told AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(eq) AS n_equal FROM found GROUP BY doc_id)
"""

DECONTAMINATION = (
    "WITH "
    + CONTAMINATED.replace("{documents}", "documents")
    + """
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items, coalesce(n_equal, 0)::BIGINT AS n_equal
FROM documents LEFT JOIN told USING (doc_id)
"""
)

#: Every capture against every interval of its keys.
URL_FILTERS = r"""
WITH parsed AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(((page_id * 7919) % 730)::INT) AS fetched,
         regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)', 1)), '\.$', '') AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^?#]*)', 2) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host AS h, ('0x' || substr(md5(host), 1, 4))::BIGINT AS k FROM parsed WHERE host <> ''),
dated AS (
  SELECT 'domain' AS kind, regexp_replace(h, '^[^.]*\.', '') AS value, 'block' AS action, k % 400 AS d FROM hosts WHERE k % 3 = 0
  UNION ALL SELECT 'host', h, 'block', k % 500 FROM hosts WHERE k % 4 = 1
  UNION ALL SELECT 'host', h, 'remove', k % 500 + 120 FROM hosts WHERE k % 4 = 1
  UNION ALL SELECT 'host', h, 'allow', k % 450 FROM hosts WHERE k % 5 = 2
  UNION ALL SELECT 'host', h, 'remove', k % 450 + 200 FROM hosts WHERE k % 5 = 2
  UNION ALL SELECT 'path', h || '/en', 'block', k % 600 FROM hosts WHERE k % 2 = 0),
once AS (SELECT kind, value, d, max(action) AS action FROM dated GROUP BY ALL),
held AS (SELECT *, lead(d) OVER (PARTITION BY kind, value ORDER BY d) AS u FROM once),
active AS (SELECT kind, value, action, TIMESTAMP '2024-01-01' + to_days(d::INT) AS since, TIMESTAMP '2024-01-01' + to_days(u::INT) AS until FROM held WHERE action <> 'remove'),
hits AS (
  SELECT page_id, kind, value, action, since,
         row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'path' THEN 0 WHEN 'host' THEN 1 ELSE 2 END, length(value) DESC) AS r
  FROM parsed JOIN active ON (kind = 'host' AND value = host OR kind = 'domain' AND (value = host OR ends_with(host, '.' || value))
                              OR kind = 'path' AND (value = host || path OR starts_with(host || path, value || '/')))
  WHERE since <= fetched AND (until IS NULL OR fetched < until))
SELECT p.page_id, p.url, p.host, epoch(p.fetched)::BIGINT AS fetched, coalesce(action = 'block', false) AS blocked, kind AS rule_kind, value AS rule_value, action AS rule_action, epoch(since)::BIGINT AS rule_since
FROM parsed p LEFT JOIN (SELECT * FROM hits WHERE r = 1) USING (page_id)
"""

#: Every pair of sets that share a shingle, then all that can be reached over links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN list_distinct(w) ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s),
shingles AS (SELECT rep, n, unnest(s) AS h FROM classes WHERE n > 0),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM shingles a JOIN shingles b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 80 * (na + nb - shared)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
least_of AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.component END AS component_id, d.doc_id = CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE l.component END AS kept
FROM sets d JOIN classes c ON c.s = list_sort(d.s) JOIN least_of l USING (rep)
"""

#: For pages of one layout, whose article is one element with paragraphs and a heading, by cutting it up.
MAIN_TEXT = r"""
WITH cut AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS parts FROM cut),
decoded AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')) AS parts FROM plain),
texts AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[[:space:]]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM decoded)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM texts
"""
