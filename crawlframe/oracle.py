"""The catalogue's queries in DuckDB's SQL, written independently of the operators."""

HREF = "regexp_extract_all(html, '<a\\s[^>]*?\\bhref=\"([^\"]*)\"', 1)"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
KEY = "regexp_replace(url, '#.*$', '')"
ENC = "array_to_string(list_transform(string_split(raw, ''), lambda c: CASE WHEN ord(c) > 127 OR c = ' ' THEN url_encode(c) ELSE c END), '')"
#: The driver's links are root-relative; each is taken at its page's host.
LINKS = f"""l AS (SELECT page_id, url AS src, generate_subscripts({HREF}, 1) - 1 AS position, unnest({HREF}) AS raw FROM pages),
r AS (SELECT page_id, position::INTEGER AS position, src, regexp_extract(src, '^[a-z]+://[^/?#]*') || {ENC} AS url FROM l)"""
STATUS = "[200, 204, 301, 401, 403, 404, 408, 418, 429, 500, 503][event_id % 11 + 1]"
CLASS = f"CASE WHEN {STATUS} IN (401, 403) THEN 'session' WHEN {STATUS} IN (408, 429) OR {STATUS} >= 500 THEN 'retryable' WHEN {STATUS} < 200 OR {STATUS} >= 400 THEN 'non_retryable' ELSE 'success' END"
JUDGED = f"""{LINKS},
j AS (SELECT *, CASE WHEN url LIKE '%/The%' THEN 'glob_excluded' WHEN url LIKE '%,' THEN 'regex_excluded'
  WHEN NOT (url LIKE '%/T%' OR url LIKE '%/O%' OR regexp_matches(url, '/[a-e][a-z]*\\.?$')) THEN 'glob_excluded' END AS reason,
  CASE WHEN url LIKE '%/T%' THEN 'T' WHEN regexp_matches(url, '/[a-e][a-z]*\\.?$') THEN 'early' WHEN url LIKE '%/O%' THEN 'O' END AS label FROM r),
u AS (SELECT * FROM j WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY position) = 1),
v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, position) > 1 AS again FROM u)"""
KV = "kv AS (SELECT concat(source, '/', doc_id % 40) AS key, doc_id AS version, n_chars AS size FROM documents QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) = 1)"
ATT = f"a AS (SELECT event_id, ts, user_id, floor(value * 1000)::BIGINT AS duration, CASE event_type WHEN 'error' THEN 'retried' WHEN 'purchase' THEN 'failed' ELSE 'succeeded' END AS outcome, {STATUS} AS status FROM events)"
SUMMARY = "count_if(outcome = 'succeeded')::BIGINT AS finished, count_if(outcome = 'failed')::BIGINT AS failed, count_if(outcome = 'retried')::BIGINT AS retries"
FNV = "list_reduce(list_transform(range(1, octet_length({0}::BLOB) + 1), lambda i: ('0x' || hex({0}::BLOB)[2 * i - 1 : 2 * i])::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, {1})"
F1, F2 = FNV.format("k", "14695981039346656037::UHUGEINT"), FNV.format("k", "a")
HEX = "lower(lpad(to_hex({0}::UBIGINT), 16, '0'))"

SQL = {
    "links_extract": f"WITH {LINKS} SELECT page_id, position::INTEGER AS position, raw FROM l",
    "links_resolve": f"WITH {LINKS} SELECT page_id, position, url FROM r",
    "links_filtered": f"WITH {LINKS} SELECT page_id, position, true AS \"all\", true AS same_hostname, true AS same_domain, true AS same_origin FROM r",
    "enqueue_skip_reasons": f"WITH {JUDGED} SELECT 'skipped' AS verdict, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT CASE WHEN again THEN 'skipped' ELSE 'added' END, CASE WHEN again THEN 'duplicate_unique_key' END, count(*) FROM v GROUP BY again",
    "enqueue_pattern_overrides": f"WITH {JUDGED} SELECT label, count(*) AS n FROM v WHERE NOT again GROUP BY label",
    "enqueue_dedup_limit": f"""WITH {LINKS}, u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY position) = 1), t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY position) <= 3),
      v AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, position) > 1 AS again FROM t) SELECT page_id, position, url, CASE WHEN again THEN 'skipped' ELSE 'added' END AS verdict, CASE WHEN again THEN 'duplicate_unique_key' END AS reason FROM v""",
    "enqueue_depth": f"WITH {LINKS} SELECT 'skipped' AS verdict, 'max_depth_exceeded' AS reason, count(*) AS n FROM (SELECT DISTINCT page_id, url FROM r)",
    "enqueue_transform": f"""WITH {LINKS}, u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY position) = 1), v AS (SELECT CASE WHEN length(url) % 2 = 1 THEN 'transform_rejected' WHEN row_number() OVER (PARTITION BY url ORDER BY page_id, position) > 1 THEN 'duplicate_unique_key' END AS reason FROM u)
      SELECT CASE WHEN reason IS NULL THEN 'added' ELSE 'skipped' END AS verdict, reason, count(*) AS n FROM v GROUP BY reason""",
    "crawl_budget": f"WITH {LINKS} SELECT page_id, position, url FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, position) = 1 ORDER BY page_id, position LIMIT 100",
    "links_per_host": f"WITH {LINKS}, u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY position) = 1) SELECT {HOST} AS host, count(*) AS links, count(DISTINCT url) AS requests FROM u GROUP BY host",
    "page_title_records": "SELECT page_id, url, nullif(trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages",
    "html_select_titles": "SELECT page_id, replace(replace(replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages",
    "html_select_anchors": f"WITH {LINKS} SELECT page_id, position::INTEGER AS position, raw FROM l",
    "raw_href_split": "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::INTEGER AS n FROM pages",
    "request_identity": f"WITH b AS (SELECT page_id, {KEY} AS k FROM pages), h AS (SELECT page_id, k, {F1} AS a FROM b) SELECT page_id, k AS unique_key, {HEX.format('a')} || {HEX.format('(' + F2 + ')')} AS request_id FROM h",
    "request_body_key": f"WITH b AS (SELECT conv_id, turn, concat('role=', role, '&turn=', turn) AS k FROM conversations) SELECT conv_id, turn, concat('POST(', {HEX.format('(' + F1 + ')')}, '):https://example.com/c/', conv_id) AS unique_key FROM b",
    "host_round_robin": f"SELECT page_id AS order_no, {HOST} AS host, row_number() OVER (PARTITION BY host ORDER BY page_id)::INTEGER AS turn, min(page_id) OVER (PARTITION BY host) AS place FROM pages",
    "queue_order_forefront": "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN -(conv_id * 100 + turn + 1) ELSE conv_id * 100 + turn + 1 END AS order_no FROM conversations ORDER BY 3 LIMIT 50",
    "queue_dedup_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "queue_semi_handled": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "queue_add_report": "WITH k AS (SELECT concat('s', doc_id % 500) AS key, bool_or(quality = 1) AS h FROM labels GROUP BY key), d AS (SELECT doc_id, concat('s', doc_id % 900) AS key FROM documents) SELECT doc_id AS order_no, k.key IS NOT NULL OR row_number() OVER (PARTITION BY d.key ORDER BY doc_id) > 1 AS already_present, coalesce(h, false) AS already_handled FROM d LEFT JOIN k ON d.key = k.key",
    "queue_counts": "SELECT count_if(event_type = 'view')::BIGINT AS pending, count_if(event_type = 'click')::BIGINT AS leased, count_if(event_type NOT IN ('view', 'click'))::BIGINT AS handled, pending = 0 AS is_empty, pending = 0 AND leased = 0 AS is_finished FROM events",
    "queue_lease_cycle": "SELECT CASE WHEN event_id % 3 = 0 THEN -(event_id + 1000000) ELSE event_id + 1000000 END AS order_no, (event_id % 3 = 2)::INTEGER AS retry_count, (event_id % 3 = 1)::INTEGER AS session_rotation_count FROM events WHERE ts <= TIMESTAMP '2024-01-15' ORDER BY event_id LIMIT 100",
    "queue_tandem": "WITH b AS (SELECT 0 AS s, doc_id AS order_no, (doc_id % 700)::VARCHAR AS unique_key FROM documents UNION ALL SELECT 1, page_id, (page_id + 650)::VARCHAR FROM pages) SELECT unique_key, order_no FROM b QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY s, order_no) = 1",
    "fetch_coalesce": "WITH e AS (SELECT event_id AS seq, user_id::VARCHAR AS key, CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method FROM events) SELECT * FROM e QUALIFY method = 'POST' OR row_number() OVER (PARTITION BY key, method ORDER BY seq) = 1",
    "redirect_chain": """WITH RECURSIVE w AS (SELECT i AS start, i AS pos, CASE WHEN i % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, 0 AS hops FROM range(400) t(i) UNION ALL SELECT start, pos - 1, CASE WHEN pos % 3 = 0 THEN 'GET' ELSE method END, hops + 1 FROM w WHERE pos % 20 <> 0 AND hops < 11)
      SELECT start::VARCHAR AS url, pos::VARCHAR AS final_url, method AS final_method, hops::INTEGER AS hops, CASE WHEN hops > 10 THEN 'too_many_redirects' ELSE 'ok' END AS status FROM w QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1""",
    "html_media_gate": "SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'non_retryable' END AS error_class FROM pages",
    "status_classify": f"SELECT event_id, {CLASS} AS class FROM events",
    "transport_classify": "SELECT CASE WHEN event_id % 5 < 3 THEN 'retryable' ELSE 'non_retryable' END AS class, count(*) AS n FROM events GROUP BY class",
    "retry_decide": f"""WITH e AS (SELECT event_id, nullif({CLASS}, 'success') AS c, event_id % 7 = 0 AS no, (user_id % 5)::INTEGER AS r, (user_id % 13)::INTEGER AS s FROM events),
      n AS (SELECT *, CASE WHEN c IS NULL THEN 'done' WHEN c <> 'non_retryable' AND NOT no AND (CASE WHEN c = 'session' THEN s < 10 ELSE r < 3 END) THEN 'retry' ELSE 'failed' END AS next FROM e)
      SELECT event_id, next, r + (next = 'retry' AND c <> 'session')::INTEGER AS retry_count, s + (next = 'retry' AND c = 'session')::INTEGER AS session_rotation_count FROM n""".replace("r + (next = 'retry' AND c <> 'session')", "r + coalesce(next = 'retry' AND c <> 'session', false)").replace("s + (next = 'retry' AND c = 'session')", "s + coalesce(next = 'retry' AND c = 'session', false)"),
    "attempt_number": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt FROM events",
    "route_label_method": "SELECT CASE WHEN role = 'user' AND turn % 3 = 0 THEN 0 WHEN role = 'user' THEN 1 WHEN turn % 3 = 1 THEN 2 ELSE -1 END::INTEGER AS route, count(*) AS n FROM conversations GROUP BY route",
    "sticky_promotion": f"SELECT event_id, {STATUS} IN (403, 503) OR coalesce(bool_or({STATUS} IN (403, 503)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rendered FROM events",
    "retry_after_parse": "SELECT event_id, [0, 120, 600, 120, 0, NULL, 7][event_id % 7 + 1]::BIGINT AS seconds FROM events",
    "antibot_headers": "SELECT page_id, ['cloudflare', 'datadome', 'perimeterx', 'kasada', 'imperva', 'akamai', 'cloudflare', NULL][page_id % 8 + 1] AS vendor FROM pages",
    "stats_error_groups": "SELECT 'GET <url> failed after #ms (code E#)' AS error_key, count(*) AS n FROM events WHERE event_type = 'error'",
    "kv_content_type": "SELECT doc_id, ['json', 'html', 'png', 'bin', 'xml', 'txt'][doc_id % 6 + 1] AS extension, ['application/json', 'text/html', 'image/png', 'application/octet-stream', 'application/xml', 'text/plain'][doc_id % 6 + 1] AS content_type FROM documents",
    "leading_integers": "SELECT event_id, user_id::INTEGER AS n FROM events",
    "stats_summary": f"WITH {ATT}, r AS (SELECT user_id, sum(duration) AS t, bool_or(outcome <> 'retried') AS done FROM a GROUP BY user_id), s AS (SELECT {SUMMARY} FROM a) SELECT s.*, sum(t)::BIGINT AS total_duration, min(t)::BIGINT AS min_duration, max(t)::BIGINT AS max_duration, (sum(t)::BIGINT // count(*))::BIGINT AS avg_duration FROM r, s WHERE done GROUP BY ALL",
    "stats_status_hist": f"WITH {ATT} SELECT status::INTEGER AS status, count(*) AS n FROM a WHERE outcome = 'succeeded' GROUP BY status",
    "stats_retry_hist": "WITH c AS (SELECT count(*) AS c FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT i AS retry_count, count(c) AS n FROM range(0, (SELECT max(c) + 1 FROM c)) t(i) LEFT JOIN c ON c = i GROUP BY i",
    "stats_rate_window": f"WITH {ATT} SELECT event_id, (count(*) FILTER (WHERE outcome = 'succeeded') OVER w) * 60 / 3600 AS finished_per_minute, (count(*) FILTER (WHERE outcome = 'failed') OVER w) * 60 / 3600 AS failed_per_minute FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)",
    "stats_runtime": "SELECT sum(epoch(date_trunc('second', b)) - epoch(date_trunc('second', a)))::BIGINT AS seconds FROM (SELECT min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)",
    "load_decision": "SELECT CASE WHEN bool_or(last) THEN 'down' WHEN avg(healthy) >= 0.9 THEN 'up' ELSE 'hold' END AS decision, avg(healthy) AS mean FROM (SELECT arg_max(event_id < 50, ts) AS last, avg((event_id >= 50)::INTEGER) AS healthy FROM events GROUP BY event_type)",
    "bench_report_quantiles": "SELECT event_type, count(*) AS n, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
    "bench_server_bound": "SELECT max(value) FILTER (WHERE event_type <> 'view') AS fastest, max(value) FILTER (WHERE event_type = 'view') AS base, fastest >= 0.7 * base AS server_bound FROM events",
    "site_totals": "SELECT count(*) AS pages, sum(octet_length(html::BLOB))::BIGINT AS bytes, sum(('0x' || md5(html)[1:15])::BIGINT % 1000003)::BIGINT AS checksum FROM pages".replace("octet_length(html::BLOB)", "strlen(html)"),
    "hit_accounting": "WITH h AS (SELECT user_id % 100 AS p, event_type <> 'click' AS own, count(*) AS n FROM events GROUP BY ALL) SELECT count_if(own AND p < 90)::BIGINT AS unique_pages, sum(n - 1) FILTER (WHERE own AND p < 90)::BIGINT AS duplicates, sum(n) FILTER (WHERE NOT own)::BIGINT AS off_host, sum(n) FILTER (WHERE own AND p >= 90)::BIGINT AS unknown FROM h",
    "dataset_page_desc": "SELECT doc_id + 1 AS seq FROM documents ORDER BY seq DESC LIMIT 25 OFFSET 10",
    "dataset_info": "SELECT 'events' AS name, count(*) AS items, min(ts) AS created, max(ts) AS modified FROM events",
    "dataset_json_keys": "SELECT unnest(['id', 'text', 'lang', 'long']) AS key",
    "dataset_typed": "SELECT doc_id + 1 AS seq, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN lang END AS lang FROM documents",
    "dataset_numbered": "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS seq FROM events",
    "kv_upsert": f"WITH {KV} SELECT * FROM kv",
    "kv_delete": f"WITH {KV} SELECT key, version FROM kv WHERE size % 2 <> 0",
    "kv_list_keys": f"WITH {KV} SELECT key, size FROM kv WHERE key > 'src1/' ORDER BY key LIMIT 50",
    "proxy_round_robin": "SELECT event_id, ['http://a:1', 'http://b:2', 'http://c:3'][event_id % 3 + 1] AS proxy FROM events",
    "proxy_info": "SELECT event_id, ['proxy.example', 'proxy.example', '10.0.0.1', 'proxy.example'][event_id % 4 + 1] AS host, [3128, 443, 80, 80][event_id % 4 + 1]::INTEGER AS port, ['u', NULL, NULL, 'u'][event_id % 4 + 1] AS username, ['p', NULL, NULL, NULL][event_id % 4 + 1] AS password FROM events",
    "proxy_bucket": "SELECT event_id, CASE WHEN event_type = 'view' THEN ['v1', 'v2'][event_id % 2 + 1] ELSE ['d1', 'd2', 'd3'][event_id % 3 + 1] END AS proxy FROM events",
    "session_usable": "SELECT event_id, event_type <> 'error' AND ts > TIMESTAMP '2024-01-10' AND user_id % 7 < 6 AND user_id % 60 < 50 AS usable FROM events",
    "bfs_tree": "SELECT d::INTEGER AS depth, (1 << d)::BIGINT AS n FROM range(8) t(d)",
    "bfs_depth_limit": """WITH e AS (SELECT DISTINCT l_partkey AS s, l_suppkey * 7 + 3 AS t FROM lineitem), a AS (SELECT i AS n FROM range(1, 4) t(i)), b AS (SELECT DISTINCT t AS n FROM e JOIN a ON s = n EXCEPT SELECT n FROM a),
      c AS (SELECT DISTINCT t AS n FROM e JOIN b ON s = n EXCEPT (SELECT n FROM a UNION SELECT n FROM b)) SELECT 0 AS depth, count(*) AS n, sum(n)::BIGINT AS total FROM a UNION ALL SELECT 1, count(*), sum(n)::BIGINT FROM b UNION ALL SELECT 2, count(*), sum(n)::BIGINT FROM c""",
    "aimd_fold": """WITH RECURSIVE e AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
      f AS (SELECT DISTINCT user_id, 10 AS n, 0 AS s, 0::BIGINT AS i FROM events UNION ALL SELECT f.user_id, CASE WHEN NOT ok THEN greatest(1, round(n * 0.5)::INTEGER) WHEN s >= 2 THEN least(n + 1, 200) ELSE n END, CASE WHEN NOT ok OR s >= 2 THEN 0 ELSE s + 1 END, f.i + 1 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
      SELECT user_id, n::INTEGER AS desired FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""",
    "sitemap_entries": "SELECT concat('https://s.example/', page_id % 6, '.xml') AS url, 'url' AS kind, count(*) AS n FROM pages GROUP BY 1 UNION ALL SELECT 'https://s.example/index.xml', 'sitemap', 6",
    "stream_stats": "SELECT event_type AS outcome, count(*) AS n, sum(floor(value * 1000)::BIGINT)::BIGINT AS total_duration, min(floor(value * 1000)::BIGINT) AS min_duration, max(floor(value * 1000)::BIGINT) AS max_duration FROM events GROUP BY outcome",
}


def _levels(n: int) -> str:
    """Breadth-first search as one query a level."""
    out = "l0 AS (SELECT 0::BIGINT AS node), s0 AS (SELECT node FROM l0)"
    for k in range(1, n + 1):
        out += f", l{k} AS (SELECT DISTINCT dst AS node FROM g JOIN l{k - 1} ON src = node EXCEPT SELECT node FROM s{k - 1}), s{k} AS (SELECT node FROM s{k - 1} UNION ALL SELECT node FROM l{k})"
    return out


STRIDES = "[3271, 5501, 6151, 7013, 7919, 4099, 2003]"
MESH = f"g AS (SELECT * FROM (SELECT i AS src, i + 1 AS dst FROM range(8192) t(i) UNION ALL SELECT i, (i * {STRIDES}[k] + k) % 8192 FROM range(8192) t(i), range(1, 8) u(k)) WHERE dst > src AND dst < 8192)"
MESH_DEPTH = 20
PAGE_HOST = HOST.replace("url,", "{0},")
DOMAIN = "array_to_string(string_split({0}, '.')[-2:], '.')"
PAGE_STATUS, PAGE_CLASS = STATUS.replace("event_id", "page_id"), CLASS.replace("event_id", "page_id")
MD5N = "('0x' || md5({0})[1:8])::BIGINT"
SYSTEMS = [("Windows NT 10.0; Win64; x64", 126), ("X11; Linux x86_64", 126), ("Macintosh; Intel Mac OS X 10_15_7", 125), ("Windows NT 10.0; Win64; x64", 124), ("X11; Linux x86_64", 123), ("Macintosh; Intel Mac OS X 10_15_7", 122), ("Windows NT 10.0; Win64; x64", 121), ("X11; Linux x86_64", 120)]
AGENTS = ", ".join(f"'Mozilla/5.0 ({s}) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{v}.0.0.0 Safari/537.36'" for s, v in SYSTEMS)
NUMBERED = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {0}) AS i FROM events)"
LAST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"
SECONDS = "(event_id * 3 + user_id % 7)::DOUBLE"
MARKS = {
    "cloudflare": ["just a moment", "cf-chl", "challenges.cloudflare.com", "checking your browser"], "datadome": ["datadome", "geo.captcha-delivery.com"], "perimeterx": ["px-captcha", "perimeterx", "/_px"],
    "kasada": ["kpsdk", "kasada"], "imperva": ["incapsula", "_incap_", "incident id"], "akamai": ["akamai bot manager", "akamaighost"], "gnu": ["gnu general"], "thth": ["thth"],
}
VENDOR = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{v}'" for v, marks in MARKS.items()) + " WHEN contains(t, 'captcha') AND (contains(t, 'access denied') OR contains(t, 'verify you are human') OR contains(t, 'are you a human')) THEN 'unknown' END"
MIX = "(xor(z, z >> {0}) * {1}::UHUGEINT) % 18446744073709551616::UHUGEINT"

SQL |= {
    "links_filtered": f"""WITH {LINKS}, q AS (SELECT page_id, position, src, url FROM r UNION ALL SELECT p.page_id, -3, p.url, n.url FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1 UNION ALL SELECT page_id, -2, url, 'mailto:a@b.example' FROM pages
      UNION ALL SELECT page_id, -1, url, CASE WHEN url LIKE 'https:%' THEN 'http:' || url[7:] ELSE 'https:' || url[6:] END FROM pages),
      h AS (SELECT *, {PAGE_HOST.format('url')} AS a, {PAGE_HOST.format('src')} AS b, url NOT LIKE 'mailto:%' AS web FROM q)
      SELECT page_id, position::INTEGER AS position, coalesce(web, false) AS "all", coalesce(web AND a = b, false) AS same_hostname, coalesce(web AND {DOMAIN.format('a')} = {DOMAIN.format('b')}, false) AS same_domain, coalesce(web AND a = b AND string_split(url, ':')[1] = string_split(src, ':')[1], false) AS same_origin FROM h""",
    "html_records": r"""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<li>(.*?)</li>', 1) AS l FROM pages), u AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS x FROM n)
      SELECT page_id, position::INTEGER AS position, trim(replace(replace(replace(regexp_extract(x, '(?s)<a[^>]*>(.*?)</a>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS name, regexp_extract(x, 'href="([^"]*)"', 1) AS href FROM u""",
    "url_parts": f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {HOST} AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
      SELECT page_id, scheme, host, CASE scheme WHEN 'http' THEN 80 WHEN 'https' THEN 443 END::INTEGER AS port, path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS extension, {DOMAIN.format('host')} AS domain FROM p""",
    "url_normalise": f"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) || '://' || {HOST} || CASE WHEN page_id % 3 = 0 THEN ':8080' ELSE '' END || '/x' || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE '' END || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS url FROM pages",
    "fetch_join": f"WITH k AS (SELECT length(html) AS size, {KEY} AS key FROM pages) SELECT p.page_id + 1 AS request, k.size::INTEGER AS size, CASE WHEN k.key IS NULL THEN 'retryable' END AS error_class FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'http://nowhere.example/' ELSE {KEY} END AS q FROM pages) p LEFT JOIN k ON q = k.key",
    "error_properties": "SELECT * FROM (VALUES ('retryable', true, false, false, false, true), ('non_retryable', false, false, false, false, true), ('session', true, true, false, false, false), ('force_retry', true, false, true, false, true), ('critical', false, false, false, true, true), ('missing_route', false, false, false, true, true), ('timeout', true, false, false, false, true)) t(error_class, retryable, rotates_session, ignores_max_retries, critical, counts_against_retries)",
    "failure_artifacts": "SELECT concat('ERROR_SNAPSHOT_', md5(user_id::VARCHAR)[1:16], '.html') AS key, props AS value, 'text/html' AS content_type, strlen(props)::BIGINT AS size FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "antibot_detect": f"SELECT doc_id, {VENDOR} AS vendor FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)",
    "promotion_detect": r"""WITH b AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<html><body> <script>go()</script></body></html>' ELSE html END AS html FROM pages),
      v AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g') AS t FROM b)
      SELECT page_id, CASE WHEN NOT regexp_matches(html, '(?i)<html[\s>/]') THEN 'selector_missing' WHEN strlen(trim(t, E' \t\n\r\f')) < 40 AND regexp_matches(html, '(?i)<script[\s>]') THEN 'empty_body_likely_js' END AS reason FROM v""",
    "stats_merge": f"WITH {ATT}, r AS (SELECT user_id, sum(duration) AS t, bool_or(outcome <> 'retried') AS done FROM a GROUP BY user_id), s AS (SELECT {SUMMARY} FROM a), d AS (SELECT sum(t)::BIGINT AS total_duration, min(t)::BIGINT AS min_duration, max(t)::BIGINT AS max_duration FROM r WHERE done) SELECT s.*, d.*, (total_duration // (finished + failed))::BIGINT AS avg_duration FROM s, d",
    "load_window": "WITH s AS (SELECT event_type AS signal, ts, value > 150 AS o, max(ts) OVER (PARTITION BY event_type) AS t FROM events), k AS (SELECT * FROM s WHERE epoch(ts) >= epoch(t) - 86400 QUALIFY row_number() OVER (PARTITION BY signal ORDER BY ts DESC) <= 4096) SELECT signal, count(*) AS n, count_if(o)::BIGINT AS overloaded FROM k GROUP BY signal",
    "digest_commutative": "WITH h AS (SELECT ('0x' || md5(event_id::VARCHAR)[1:15])::BIGINT AS h FROM events), d AS (SELECT count(*) AS n, sum(h::HUGEINT) % 18446744073709551616 AS total, bit_xor(h) AS mixed FROM h) SELECT n, total::VARCHAR AS total, mixed, ((total + (mixed & 140737488355327)::HUGEINT * 131072 + (mixed >> 47)) % 18446744073709551616)::VARCHAR AS digest FROM d",
    "dataset_csv_rows": "WITH c AS (SELECT doc_id, lang, n_chars, CASE WHEN regexp_matches(text, '[,\"\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE coalesce(text, '') END AS t FROM documents) SELECT doc_id + 1 AS seq, concat_ws(',', doc_id::VARCHAR, CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, '') ELSE '' END, coalesce((n_chars > 1000)::VARCHAR, ''), t) AS line FROM c",
    "header_profile_pick": f"SELECT event_id, [{AGENTS}][{MD5N.format('event_id::VARCHAR')} % 8 + 1] AS user_agent FROM events",
    "user_agent_pick": f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'own' WHEN event_id % 2 = 0 THEN ['a', 'b', 'c'][{MD5N.format('user_id::VARCHAR')} % 3 + 1] ELSE ['a', 'b', 'c'][event_id % 3 + 1] END AS user_agent FROM events",
    "cookie_match": f"""WITH p AS (SELECT page_id, url, {HOST} AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), g AS (SELECT h AS d, min(page_id) AS i FROM p WHERE page_id % 3 = 0 GROUP BY h),
      c AS (SELECT d, concat('c', i) AS n, i::VARCHAR AS v, i % 2 = 0 AS host_only, CASE WHEN i % 4 = 0 THEN '/en' ELSE '/' END AS below, i % 5 = 0 AS secure FROM g UNION ALL SELECT 'example.com', 'top', '1', false, '/', false),
      m AS (SELECT url, string_agg(concat(n, '=', v), '; ' ORDER BY length(below) DESC, n, v) AS cookie_header FROM p JOIN c ON (h = d OR NOT host_only AND ends_with(h, '.' || d)) AND (path = below OR starts_with(path, below) AND (below = '/' OR path[length(below) + 1] = '/')) AND (NOT secure OR url LIKE 'https:%') GROUP BY url)
      SELECT page_id, cookie_header FROM p LEFT JOIN m USING (url)""",
    "bfs_tree": "SELECT d::INTEGER AS depth, (1 << d)::BIGINT AS n FROM range(13) t(d)",
    "bfs_mesh": f"WITH {MESH}, {_levels(MESH_DEPTH)} " + " UNION ALL ".join(f"SELECT node, {k} AS depth FROM l{k}" for k in range(MESH_DEPTH + 1)),
    "crawl_books": "SELECT concat('https://shop.example/book/', i) AS url, concat('Book ', i) AS title, printf('£%d.%02d', (199 + i * 7919 % 4801) // 100, (199 + i * 7919 % 4801) % 100) AS price, 'In stock' AS stock FROM range(5000) t(i)",
    "scale_fold": f"""WITH RECURSIVE {NUMBERED.format('event_id')}, f AS (SELECT DISTINCT user_id, 20 AS n, 0::BIGINT AS i FROM events UNION ALL
      SELECT f.user_id, CASE event_type WHEN 'view' THEN least(n + greatest(ceil(n * 0.05), 1), 200) WHEN 'error' THEN greatest(n - greatest(ceil(n * 0.05), 1), 1) ELSE n END::INTEGER, f.i + 1 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
      SELECT user_id, n AS desired FROM f {LAST}""",
    "token_bucket": f"""WITH RECURSIVE {NUMBERED.format('event_id')}, f AS (SELECT DISTINCT user_id, 1.0::DOUBLE AS tokens, NULL::DOUBLE AS last, 0::BIGINT AS granted, 0::BIGINT AS i FROM events UNION ALL
      SELECT user_id, CASE WHEN t >= 1 THEN t - 1 ELSE t END, now, granted + (t >= 1)::BIGINT, i FROM (
        SELECT f.user_id, {SECONDS.replace('user_id', 'e.user_id')} / 50 AS now, least(tokens + greatest(0.0, {SECONDS.replace('user_id', 'e.user_id')} / 50 - coalesce(last, {SECONDS.replace('user_id', 'e.user_id')} / 50)) * 0.5, 30.0) AS t, granted, e.i FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
      SELECT user_id, granted FROM f {LAST}""",
    "host_limiter": f"""WITH RECURSIVE e AS (SELECT user_id, {SECONDS} AS now, event_id % 3 = 0 AS response, {STATUS}::DOUBLE AS status, CASE WHEN event_id % 9 = 0 THEN 20.0::DOUBLE END AS late, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
      f AS (SELECT DISTINCT user_id, NULL::DOUBLE AS next, NULL::DOUBLE AS last, 0 AS n, 0.0::DOUBLE AS penalty, NULL::DOUBLE AS "at", NULL::DOUBLE AS wait, 0::BIGINT AS i FROM events UNION ALL
      SELECT user_id, CASE WHEN NOT response THEN slot + 2 + penalty WHEN late IS NOT NULL THEN greatest(now + late, coalesce(after, now + late)) ELSE after END, CASE WHEN response THEN last ELSE slot END,
        CASE WHEN response THEN n2 ELSE n END, CASE WHEN response THEN p2 ELSE penalty END, now, CASE WHEN NOT response THEN slot - now END, i FROM (
        SELECT *, CASE WHEN status = 429 THEN greatest(coalesce(last + 2, next, now), now) + p2 ELSE last + 2 END AS after FROM (
          SELECT *, CASE WHEN status = 429 THEN least(2.0 * 2 ** least(n2 - 1, 31), 300.0)::DOUBLE ELSE 0.0 END AS p2 FROM (
            SELECT f.user_id, next, last, n, penalty, now, response, status, late, e.i, greatest(coalesce(next, now), now) AS slot, CASE WHEN status = 429 THEN n + 1 ELSE 0 END AS n2 FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))))
      SELECT user_id, "at", wait FROM f WHERE i > 0""",
    "proxy_tiers": f"""WITH RECURSIVE {NUMBERED.format('event_id')}, f AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0 AS tier, 0 AS n, NULL::INTEGER AS served, NULL::INTEGER AS member, 0::BIGINT AS i FROM events UNION ALL
      SELECT user_id, event_id, CASE WHEN blocked AND NOT probe THEN least(tier + 1, 2) WHEN NOT blocked AND probe THEN served ELSE tier END, CASE WHEN blocked <> probe THEN 0 ELSE n END, served, n % [2, 3, 1][served + 1], i FROM (
        SELECT *, CASE WHEN probe THEN tier - 1 ELSE tier END AS served FROM (
          SELECT f.user_id, e.event_id, tier, n + 1 AS n, event_type = 'error' AS blocked, tier > 0 AND (n + 1) % 5 = 0 AS probe, e.i FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)))
      SELECT user_id, event_id, served AS tier, member FROM f WHERE i > 0""".replace("WHEN blocked <> probe THEN 0", "WHEN blocked AND NOT probe OR NOT blocked AND probe THEN 0"),
    "session_pool": f"""WITH RECURSIVE {NUMBERED.format('event_id')},
      f AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, []::STRUCT(id BIGINT, score INTEGER, used INTEGER, till DOUBLE)[] AS pool, 0::BIGINT AS next, NULL::BIGINT AS session, false AS created, 0::BIGINT AS i FROM events UNION ALL
      SELECT user_id, event_id, list_transform(pool, lambda x: CASE WHEN x.id = session THEN struct_pack(id := x.id, score := CASE WHEN ok THEN greatest(0, x.score - 500) ELSE x.score + 1000 END, used := x.used + 1, till := x.till) ELSE x END), next, session, created, i FROM (
        SELECT user_id, event_id, ok, i, created, next + created::BIGINT AS next, CASE WHEN created THEN list_append(pool, struct_pack(id := next, score := 0, used := 0, till := now + 3000)) ELSE pool END AS pool,
          CASE WHEN stuck IS NOT NULL THEN stuck WHEN created THEN next ELSE pool[{MD5N.format("concat('0:', event_id)")} % greatest(len(pool), 1) + 1].id END AS session FROM (
          SELECT * REPLACE (CASE WHEN stuck IS NULL THEN good ELSE pool END AS pool), stuck IS NULL AND len(good) < 3 AS created FROM (
            SELECT *, list_filter(good, lambda x: x.id = wanted)[1].id AS stuck FROM (
              SELECT f.user_id, e.event_id, next, pool, e.i, event_type <> 'error' AS ok, e.now, CASE WHEN e.event_id % 4 = 0 THEN 0 END AS wanted, list_filter(pool, lambda x: x.score < 3000 AND x.used < 50 AND e.now < x.till) AS good FROM f JOIN (SELECT *, {SECONDS} AS now FROM e) e ON e.user_id = f.user_id AND e.i = f.i + 1)))))
      SELECT user_id, event_id, session, created FROM f WHERE i > 0""",
    "sitemap_nesting": '''WITH m AS (SELECT page_id % 6 AS map, row_number() OVER (PARTITION BY page_id % 6 ORDER BY page_id) - 1 AS "at", url AS loc FROM pages) SELECT map, "at", loc FROM m QUALIFY row_number() OVER (PARTITION BY loc ORDER BY map, "at") = 1''',
    "enqueue_rewrite": f"""WITH {LINKS}, u AS (SELECT page_id, position, url AS old, regexp_replace(url, '[.,]+$', '') AS url FROM r QUALIFY row_number() OVER (PARTITION BY page_id, r.url ORDER BY position) = 1),
      k AS (SELECT *, CASE WHEN regexp_matches(url, '/[A-Z]') THEN concat('own:', url) ELSE regexp_replace(url, '#.*$', '') END AS unique_key, length(old) % 2 = 0 AS bad FROM u),
      w AS (SELECT *, CASE WHEN bad THEN 'transform_rejected' WHEN row_number() OVER (PARTITION BY unique_key, bad ORDER BY page_id, position) > 1 THEN 'duplicate_unique_key' END AS reason FROM k)
      SELECT page_id, position, url, unique_key, CASE WHEN reason IS NULL THEN 'added' ELSE 'skipped' END AS verdict, reason FROM w""",
    "enqueue_skipped_links": f"WITH {JUDGED} SELECT page_id, reason, count(*) AS n, min(position)::BIGINT AS first FROM (SELECT page_id, reason, position FROM j WHERE reason IS NOT NULL UNION ALL SELECT page_id, 'duplicate_unique_key', position FROM v WHERE again) GROUP BY page_id, reason",
    "links_explicit": f"""WITH {LINKS}, x AS (SELECT page_id, position + 1 AS position, url FROM r UNION ALL SELECT page_id, 0, concat('https://elsewhere.example/', page_id % 50) FROM pages), u AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY position) = 1),
      w AS (SELECT row_number() OVER (PARTITION BY url ORDER BY page_id, position) > 1 AS again FROM u) SELECT CASE WHEN again THEN 'skipped' ELSE 'added' END AS verdict, CASE WHEN again THEN 'duplicate_unique_key' END AS reason, count(*) AS n FROM w GROUP BY again""",
    "browser_anchors": f"""WITH x AS (SELECT page_id, 0 AS position, url FROM pages UNION ALL SELECT page_id, 1, 'https://other.example/a' FROM pages), w AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY page_id, position) > 1 AS again FROM x)
      SELECT page_id, position, url, CASE WHEN again THEN 'skipped' ELSE 'added' END AS verdict, CASE WHEN again THEN 'duplicate_unique_key' END AS reason FROM w""",
    "user_data": "SELECT event_id, (props->>'k')::BIGINT AS k, NULL::VARCHAR AS missing, event_type AS label, (props->>'k')::BIGINT AS k_kept FROM events",
    "http_view": f"SELECT page_id AS unique_key, CASE WHEN page_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, {KEY} AS url, page_id::VARCHAR AS a FROM pages",
    "request_headers": "SELECT event_id, event_type AS appended, 2 AS n, user_id::VARCHAR AS replaced, 1 AS n_replaced FROM events",
    "response_body": "SELECT event_id, (length(props) + (event_id % 2 = 0)::INTEGER)::INTEGER AS n, CASE WHEN event_id % 2 = 1 THEN (props->>'k')::BIGINT END AS k FROM events",
    "attempt_observed": f"SELECT page_id AS unique_key, {PAGE_STATUS}::INTEGER AS status, CASE WHEN page_id % 2 = 0 THEN 'http://a:1' ELSE 'http://b:2' END AS proxy, strlen(html)::BIGINT AS response_bytes, nullif({PAGE_CLASS}, 'success') AS error_class FROM pages",
    "navigation_hooks": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'retryable' WHEN page_id % 3 = 0 THEN 'critical' WHEN length(url) % 2 = 0 THEN 'session' END AS error_class FROM pages",
    "rendered_fetch": "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN length(html) WHEN page_id % 2 = 0 THEN -1 END::INTEGER AS size, CASE WHEN page_id % 6 = 3 THEN 'retryable' END AS error_class FROM pages",
    "error_causes": f"SELECT event_id, ['retryable', 'non_retryable', 'non_retryable', 'non_retryable', 'retryable', 'critical'][event_id % 6 + 1] AS class, CASE WHEN event_id % 2 = 0 THEN {STATUS} END::INTEGER AS status, user_id AS retry_after FROM events",
    "browser_errors": "SELECT CASE WHEN event_id % 5 = 3 THEN 'non_retryable' ELSE 'retryable' END AS class, count(*) AS n FROM events GROUP BY class",
    "retry_strategy": f"""WITH c AS (SELECT *, {CLASS} AS c, (user_id % 5)::INTEGER AS r FROM events), n AS (SELECT *, CASE WHEN c = 'success' THEN 'done' WHEN CASE event_type WHEN 'purchase' THEN false WHEN 'signup' THEN true ELSE c = 'session' OR c = 'retryable' AND r < event_id % 4 END THEN 'retry' ELSE 'failed' END AS next FROM c)
      SELECT event_id, next, r + (next = 'retry' AND c <> 'session')::INTEGER AS retry_count FROM n""",
    "carried_overrides": "WITH o AS (SELECT user_id, concat('agent-', max(event_id)) AS a FROM events WHERE event_type = 'error' AND user_id % 2 = 0 GROUP BY user_id) SELECT event_id, coalesce(a, 'plain') AS user_agent FROM events LEFT JOIN o USING (user_id)",
    "lease_results": "SELECT event_id AS lease_id, event_type, CASE WHEN event_id % 3 <> 0 THEN user_id::VARCHAR END AS unique_key, CASE WHEN event_id % 3 <> 0 THEN user_id % 4 END::INTEGER AS retry_count, event_id % 3 <> 0 AS found FROM events",
    "queue_abort": "SELECT event_id, CASE WHEN event_type = 'click' THEN -(event_id + 1) ELSE event_id END AS order_no, CASE WHEN event_type IN ('view', 'click') THEN 'pending' ELSE 'handled' END AS status FROM events",
    "deferred_starts": "SELECT event_id FROM events ORDER BY ts + to_minutes(user_id::INTEGER), event_id LIMIT 200",
    "terminal_rows": f"WITH {ATT} SELECT user_id AS request_id, event_id, outcome FROM a WHERE outcome <> 'retried' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1",
    "storage_load": "SELECT CASE WHEN arg_max(event_type = 'error', ts) THEN 'down' WHEN avg((event_type <> 'error')::INTEGER) >= 0.9 THEN 'up' ELSE 'hold' END AS decision, avg((event_type <> 'error')::INTEGER) AS mean FROM events WHERE event_type <> 'signup'",
    "sessions_restored": "SELECT event_id::VARCHAR AS id, value AS error_score, user_id AS usage_count FROM events WHERE event_id % 10 <> 0 AND ts > TIMESTAMP '2024-01-10'",
    "state_persisted": "SELECT 2 * count(*) AS finished, 2 * count_if(event_type = 'error')::BIGINT AS failed FROM events",
    "kv_json": "SELECT doc_id::VARCHAR AS key, lang, n_chars::BIGINT AS n_chars FROM documents",
    "kv_purge": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'INPUT.json' ELSE 'INPUT' END AS key FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 < 2",
    "file_names": "SELECT concat('k', doc_id) AS key, concat('k', doc_id, '.', ['json', 'html', 'png', 'bin'][doc_id % 4 + 1]) AS file FROM documents",
    "valid_names": "SELECT event_id, event_id % 7 IN (0, 6) AS valid FROM events",
    "rfc3339_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS shown, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) - 3600000000 WHEN 2 THEN epoch_us(ts) END AS micros FROM events",
    "random_numbers": f"WITH a AS (SELECT event_id, (event_id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM events), b AS (SELECT event_id, {MIX.format(30, 13787848793156543929)} AS z FROM a), c AS (SELECT event_id, {MIX.format(27, 10723151780598845931)} AS z FROM b) SELECT event_id, {HEX.format('xor(z, z >> 31)')} AS number FROM c",
    "cookies_upserted": "WITH c AS (SELECT concat('c', user_id % 20) AS name, concat('h', user_id % 3, '.example') AS domain, '/' AS path, event_id::VARCHAR AS value, event_type = 'click' AS new FROM events WHERE event_type IN ('view', 'click') AND user_id % 7 <> 0) SELECT name, domain, path, value FROM c QUALIFY row_number() OVER (PARTITION BY name, domain ORDER BY new DESC, value DESC) = 1",
    "crawl_failures": "SELECT url, 404 AS status, 'non_retryable' AS error_class FROM pages WHERE page_id % 5 = 0",
    "crawl_drained": "SELECT concat('https://shop.example/book/', i) AS url, 1 AS depth FROM range(10) t(i) UNION ALL SELECT 'https://shop.example/list/1', 1",
    "hits_equal": "SELECT true AS same, false AS other",
}

SQL |= {
    "percent_decoded": f"WITH {LINKS} SELECT page_id, position::INTEGER AS position, regexp_extract(src, '^[a-z]+://[^/?#]*') || raw || '%zz' || chr(65533) || '%' AS text FROM l",
    "request_json_key": f"""WITH b AS (SELECT event_id, concat('{{"user_id":', user_id, ',"event_type":"', event_type, '"}}') AS k FROM events) SELECT event_id, concat('PUT(', {HEX.format('(' + F1 + ')')}, '):https://example.com/e') AS unique_key FROM b""",
    "cookies_parsed": """WITH e AS (SELECT event_id, user_id, event_id % 7 <> 0 AS ok, event_id % 2 = 0 AS even FROM events) SELECT event_id, CASE WHEN ok THEN concat('c', user_id % 20) END AS name, CASE WHEN ok THEN concat('v=', event_id) END AS value,
      CASE WHEN ok THEN CASE WHEN even THEN 'example.com' ELSE 'h.example' END END AS domain, CASE WHEN ok THEN NOT even END AS host_only, CASE WHEN ok THEN CASE WHEN even THEN '/p' ELSE '/' END END AS path, CASE WHEN ok THEN even END AS secure, CASE WHEN ok THEN NOT even END AS http_only, CASE WHEN ok AND even THEN 'Lax' END AS same_site FROM e""",
    "proxy_random": f"SELECT event_id, ['http://a:1', 'http://b:2', 'http://c:3'][{MD5N.format('event_id::VARCHAR')} % 3 + 1] AS proxy FROM events",
    "skip_navigation": "SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 2 = 1 THEN length(html) END::INTEGER AS size, CASE WHEN page_id % 3 <> 0 AND page_id % 2 = 0 THEN 'retryable' END AS error_class FROM pages",
    "sitemap_failures": "SELECT concat('https://s.example/', x, '.xml') AS url, CASE x WHEN '1' THEN 'broken' WHEN '2' THEN 'failed' ELSE 'read' END AS status FROM (SELECT unnest(['0', '1', '2', '3', '4', '5', 'index']) AS x)",
    "sitemap_resumed": "SELECT page_id % 6 AS map, url AS loc FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id % 6, page_id) = 1 ORDER BY page_id % 6, page_id LIMIT 100 OFFSET 20",
}
