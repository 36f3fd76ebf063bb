"""Profiling, sampling, dedup, joins, windows and aggregates over the driver's tables."""

from __future__ import annotations

from tessera.plans.tables import sql_query

sql_query("w02_seeded_stratified_sample", """
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('20261013', CAST(doc_id AS VARCHAR(20))))) AS rn FROM @documents) t
WHERE rn <= 50""")

sql_query("w06_speaker_paragraphs", """
WITH marked AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS fresh FROM @conversations),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS paragraph FROM marked)
SELECT conv_id, CAST(paragraph AS BIGINT) AS paragraph, min(role) AS speaker, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM runs GROUP BY conv_id, paragraph""")

sql_query("w07_speaker_numbers", """
SELECT conv_id, role, first_turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) AS BIGINT) AS speaker
FROM (SELECT conv_id, role, min(turn) AS first_turn FROM @conversations GROUP BY conv_id, role) t""")

sql_query("w11_budget_prefix", """
WITH p AS (SELECT doc_id, no, greatest(1, CAST(bround(length(line) / 3.8) AS INT)) AS tokens FROM @documents LATERAL VIEW posexplode(split(text, '\\n')) x AS no, line WHERE length(line) > 0),
r AS (SELECT doc_id, no, tokens, sum(tokens + 1) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM p)
SELECT doc_id, CAST(greatest(count_if(upto <= 1000), 1) AS BIGINT) AS units, count(*) AS all_units, count_if(upto <= 1000) < count(*) AS truncated FROM r GROUP BY doc_id""",
"""
WITH p AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM @documents),
q AS (SELECT doc_id, no, greatest(1, CAST(round_even(length(line) / 3.8, 0) AS INT)) AS tokens FROM p WHERE length(line) > 0),
r AS (SELECT doc_id, no, tokens, sum(tokens + 1) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM q)
SELECT doc_id, CAST(greatest(count(*) FILTER (upto <= 1000), 1) AS BIGINT) AS units, count(*) AS all_units, count(*) FILTER (upto <= 1000) < count(*) AS truncated FROM r GROUP BY doc_id""")

sql_query("w28_event_log_tail", """
SELECT event_id, user_id, seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM @events) t
WHERE seq > n - 20""")

sql_query("w06_sessionize_gap", """
WITH m AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '30' MINUTE THEN 1 ELSE 0 END AS fresh FROM @events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(event_id) AS least_event FROM s GROUP BY user_id, session""")

sql_query("st01_rate_attempts", """
SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '60' MINUTE PRECEDING AND CURRENT ROW) AS in_window FROM @events""")

sql_query("st_tumbling_counts", """
SELECT event_type, CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 3600000000) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM @events GROUP BY 1, 2""",
"""SELECT event_type, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM @events GROUP BY 1, 2""")

sql_query("st05_liveness", """
SELECT user_id, max(ts) AS last_seen, max(ts) >= (SELECT max(ts) FROM @events) - INTERVAL '1' DAY AS online FROM @events GROUP BY user_id""")

sql_query("st13_idempotent_submission", """
SELECT user_id, event_type, min_by(event_id, event_id) AS job, count(*) - 1 AS repeats FROM @events GROUP BY user_id, event_type""",
"""SELECT user_id, event_type, min(event_id) AS job, count(*) - 1 AS repeats FROM @events GROUP BY user_id, event_type""")

sql_query("a03_merge_statistics", """
WITH part AS (SELECT l_linenumber AS g, min(l_shipdate) AS lo, max(l_shipdate) AS hi, count(*) - count(l_shipdate) AS nulls, count(*) AS n FROM @lineitem GROUP BY l_linenumber)
SELECT min(lo) AS least, max(hi) AS most, CAST(sum(nulls) AS BIGINT) AS nulls, CAST(sum(n) AS BIGINT) AS total FROM part""")

sql_query("a07_table_summary", """
SELECT l_returnflag, count(*) AS total, min(l_quantity) AS least, max(l_quantity) AS most, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price FROM @lineitem GROUP BY l_returnflag""")

sql_query("a08_modal_field_count", """
WITH n AS (SELECT doc_id, length(line) - length(replace(line, ',', '')) + 1 AS fields FROM @documents LATERAL VIEW explode(split(text, '\\n')) x AS line WHERE length(line) > 0),
c AS (SELECT fields, count(*) AS n FROM n GROUP BY fields)
SELECT CAST(fields AS BIGINT) AS fields, n, round(n / sum(n) OVER (), 6) AS share FROM c""",
"""
WITH n AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM @documents),
c AS (SELECT length(line) - length(replace(line, ',', '')) + 1 AS fields, count(*) AS n FROM n WHERE length(line) > 0 GROUP BY 1)
SELECT CAST(fields AS BIGINT) AS fields, n, round(n / sum(n) OVER (), 6) AS share FROM c""")

sql_query("a10_failure_clusters", """
SELECT event_type, regexp_replace(props, '[0-9]+', '#') AS shape, count(*) AS n, min(event_id) AS sample FROM @events GROUP BY 1, 2""",
"""SELECT event_type, regexp_replace(props, '[0-9]+', '#', 'g') AS shape, count(*) AS n, min(event_id) AS sample FROM @events GROUP BY 1, 2""")

sql_query("a15_paired_difference", """
SELECT count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS a, round(avg(CAST(toxic AS DOUBLE)), 6) AS b, round(avg(CAST(quality - toxic AS DOUBLE)), 6) AS difference
FROM @labels l JOIN @documents d ON l.doc_id = d.doc_id""")

sql_query("a16_stratified_mean", """
SELECT round(avg(m), 6) AS mean_of_means, count(*) AS strata FROM (SELECT lang, avg(CAST(quality AS DOUBLE)) AS m FROM @labels l JOIN @documents d ON l.doc_id = d.doc_id GROUP BY lang) t""")

sql_query("a17_queue_gauges", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM @orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")

sql_query("a18_histogram_cumulative", """
SELECT event_type, count_if(value <= 1) AS le_1, count_if(value <= 5) AS le_5, count_if(value <= 10) AS le_10, count_if(value <= 50) AS le_50, count_if(value <= 100) AS le_100, count(*) AS le_inf, round(sum(value), 4) AS total FROM @events GROUP BY event_type""",
"""SELECT event_type, count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 5) AS le_5, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100, count(*) AS le_inf, round(sum(value), 4) AS total FROM @events GROUP BY event_type""")

sql_query("a19_active_counts", """
SELECT o_custkey, count(*) AS active FROM @orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey""")

sql_query("a21_scorecard", """
SELECT lang, round(avg(CAST(quality AS DOUBLE)), 6) AS mean, min(quality) AS least, round(avg(CASE WHEN quality >= 1 AND toxic = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS pass FROM @labels l JOIN @documents d ON l.doc_id = d.doc_id GROUP BY lang""")

sql_query("a22_pooled_accuracy", """
SELECT round(CAST(sum(good) AS DOUBLE) / sum(n), 6) AS pooled, round(avg(CAST(good AS DOUBLE) / n), 6) AS mean_of_ratios FROM (SELECT source, count(*) AS n, sum(quality) AS good FROM @labels l JOIN @documents d ON l.doc_id = d.doc_id GROUP BY source) t""")

sql_query("a25_word_count", """
SELECT doc_id, CAST(regexp_count(text, '[^ \\n\\t\\r]*[A-Za-z0-9_][^ \\n\\t\\r]*') AS BIGINT) AS words FROM @documents""",
"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\n\\t\\r]*[A-Za-z0-9_][^ \\n\\t\\r]*')) AS BIGINT) AS words FROM @documents""")

sql_query("a28_language_mix", """
SELECT lang, CAST(sum(octet_length(text)) AS BIGINT) AS bytes, count(*) AS docs FROM @documents GROUP BY lang""",
"""SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS docs FROM @documents GROUP BY lang""")

sql_query("a34_content_hash", """SELECT doc_id, sha2(text, 256) AS sha256, md5(text) AS md5 FROM @documents""", """SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM @documents""")

sql_query("a35_participants", """
SELECT conv_id, count(DISTINCT role) AS speakers, count(*) AS turns, min(role) AS first_role FROM @conversations GROUP BY conv_id""")

sql_query("a01_element_counts", """
SELECT page_id, CAST(regexp_count(html, '<p[ >]') AS BIGINT) AS paragraphs, CAST(regexp_count(html, '<a[ >]') AS BIGINT) AS links, CAST(regexp_count(html, '<h[1-6][ >]') AS BIGINT) AS headings, CAST(regexp_count(html, '<li[ >]') AS BIGINT) AS items FROM @pages""",
"""SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS links, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS items FROM @pages""")

sql_query("j01_captures_with_totals", """
SELECT d.doc_id, d.lang, t.n FROM @documents d JOIN (SELECT lang, count(*) AS n FROM @documents GROUP BY lang) t ON d.lang = t.lang""")

sql_query("j05_paired_runs", """
SELECT a.o_custkey, a.n AS n_a, b.n AS n_b, a.n - b.n AS difference FROM (SELECT o_custkey, count(*) AS n FROM @orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a
JOIN (SELECT o_custkey, count(*) AS n FROM @orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.o_custkey = b.o_custkey""")

sql_query("j06_incremental_antijoin", """
WITH now AS (SELECT doc_id, md5(text) AS sha FROM @documents), previous AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'changed' ELSE md5(text) END AS sha FROM @documents WHERE lang <> 'es')
SELECT n.doc_id, n.sha FROM now n LEFT ANTI JOIN previous p ON n.doc_id = p.doc_id AND n.sha = p.sha""",
"""
WITH now AS (SELECT doc_id, md5(text) AS sha FROM @documents), previous AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'changed' ELSE md5(text) END AS sha FROM @documents WHERE lang <> 'es')
SELECT n.doc_id, n.sha FROM now n WHERE NOT EXISTS (SELECT 1 FROM previous p WHERE n.doc_id = p.doc_id AND n.sha = p.sha)""")

sql_query("j07_heldout_split", """
SELECT doc_id FROM @documents EXCEPT SELECT doc_id FROM @labels""")

sql_query("j28_set_jaccard", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM @orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey AS k FROM @orders WHERE o_orderpriority LIKE '5%')
SELECT round(CAST(count(*) AS DOUBLE) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - count(*)), 6) AS jaccard, count(*) AS shared FROM a JOIN b ON a.k = b.k""")

sql_query("so04_multiset_difference", """SELECT lang FROM @documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang FROM @documents WHERE doc_id % 2 = 1""")
sql_query("so01_union_warnings", """SELECT doc_id, 'toxic' AS code FROM @labels WHERE toxic = 1 UNION SELECT doc_id, 'low_quality' FROM @labels WHERE quality = 0""")
sql_query("so07_last_wins", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM @events) t WHERE rn = 1""")
sql_query("sl02_rarest_first", """SELECT source, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*), source) AS BIGINT) AS place FROM @documents GROUP BY source""")
sql_query("sl03_top_clusters", """SELECT source, n FROM (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS rn FROM (SELECT source, count(*) AS n FROM @documents GROUP BY source) c) t WHERE rn <= 5""")
sql_query("sl06_latest_match", """SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS latest FROM @orders GROUP BY o_custkey""", """SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS latest FROM @orders GROUP BY o_custkey""")

sql_query("pf01_capture_filter", """
SELECT page_id, url FROM @pages WHERE url IS NOT NULL AND html IS NOT NULL AND regexp_extract(url, '^https?://[^/:]*[.]([a-z]+)', 1) IN ('com', 'org')""")
sql_query("fa11_url_parts", """
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM @pages""")

