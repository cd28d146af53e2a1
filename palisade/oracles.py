"""DuckDB SQL with the same rows as the registered queries."""

AS_OF = "TIMESTAMP '2024-01-29 18:30:00'"
TODAY = "DATE '2024-01-29'"

EVENTS = """e AS (
  SELECT 'EVT' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_id, ts AS occurred_at,
    CASE WHEN value >= 80 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS risk_level,
    CASE event_type WHEN 'error' THEN 'sqli' WHEN 'click' THEN 'xss' WHEN 'signup' THEN 'brute force' WHEN 'view' THEN 'port scan' ELSE 'path traversal' END AS attack_type,
    CAST(10 + user_id % 190 AS VARCHAR) || '.' || CAST(event_id % 7 AS VARCHAR) || '.0.' || CAST(user_id % 250 + 1 AS VARCHAR) AS source_ip,
    'node-' || lpad(CAST(user_id % 8 AS VARCHAR), 2, '0') AS target_node,
    '/api/' || event_type || '/' || CAST(event_id % 100 AS VARCHAR) AS target_interface,
    CASE WHEN event_id % 10 < 8 THEN 'blocked' ELSE 'success' END AS attack_result,
    CASE event_id % 4 WHEN 0 THEN 'unprocessed' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'ignored' END AS process_status,
    CASE WHEN event_id % 4 >= 2 THEN 1 ELSE 0 END AS acked, CAST(floor(value * 10) AS BIGINT) AS response_ms,
    CASE WHEN value >= 80 OR event_id % 11 = 0 THEN 1 ELSE 0 END AS anomaly_detected, user_id % 8 + 1 AS machine_id, props AS request_log,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'note ' || CAST(event_id AS VARCHAR) END AS note, value AS score, event_id AS number
  FROM events)"""
MACHINES = """m AS (
  SELECT s_suppkey AS id, printf('node-%02d', s_suppkey - 1) AS machine_name, CASE WHEN s_suppkey % 4 = 0 THEN 'offline' ELSE 'online' END AS online_status FROM supplier)"""
BLOCKS = """b AS (
  SELECT source_ip AS ip_address, arg_max(event_id, occurred_at) AS source_event_id, max(occurred_at) AS blocked_at,
    'risk ' || arg_max(risk_level, occurred_at) AS reason FROM e WHERE number % 13 = 0 GROUP BY source_ip)"""
GEO = "g AS (SELECT CAST(n_nationkey * 8 + 10 AS INTEGER) AS first_octet, n_name AS region FROM nation)"
LOGS = """l AS (
  SELECT o_orderkey AS id, 'user' || CAST(o_custkey AS VARCHAR) AS username, CASE WHEN o_orderstatus = 'P' THEN 'admin' ELSE 'normal' END AS role,
    lower(o_orderpriority) AS action, o_orderdate AS created_at FROM orders)"""
METRICS = """x AS (
  SELECT l_shipdate AS metric_time, l_discount AS drift_score, 1 - l_tax AS accuracy, 1 - l_discount AS recall_rate, l_quantity AS inference_ms FROM lineitem)"""
REQUESTS = """r AS (
  SELECT 'batch-' || CAST(page_id % 50 AS VARCHAR) AS file_id, page_id AS seq_id, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
    coalesce(nullif(regexp_extract(url, '(?s)^[^:]*://[^/?#]*(.*)$', 1), ''), '/') AS uri, lower(regexp_extract(url, '(?s)^[^:]*://([^/?#]*)', 1)) AS host,
    CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 11 = 0 THEN 500 ELSE 200 END AS status_code,
    CASE WHEN page_id % 3 = 0 THEN 'application/json' ELSE 'text/html' END AS content_type,
    'agent/' || CAST(page_id % 9 AS VARCHAR) AS user_agent, html AS body, html AS response FROM pages)"""


def label(column: str, strict: bool = False) -> str:
    """The canonical attack label of a raw one."""
    word, plain = f"trim(coalesce({column}, ''))", f"translate(lower(trim(coalesce({column}, ''))), ' _-', '')"
    tests = [
        ("SQL注入", ["sql"], []), ("XSS", ["xss", "<script"], []), ("DDoS", ["ddos"], []), ("SSRF", ["ssrf"], []), ("RCE", ["rce", "remotecode"], ["远程代码"]),
        ("暴力破解", ["bruteforce"], ["暴力破解", "爆破"]), ("端口扫描", ["portscan", "nmap"], ["端口扫描"]), ("路径遍历", ["traversal"], ["路径遍历"]),
        ("文件上传", ["upload"], ["文件上传"]), ("命令注入", ["cmd", "commandinject"], ["命令注入"]),
    ]
    if strict:
        tests.sort(key=lambda t: t[0] != "暴力破解")
    when = [f"WHEN {' OR '.join([f'contains({plain}, {q!r})' for q in a] + [f'contains({word}, {q!r})' for q in b])} THEN '{name}'" for name, a, b in tests]
    return f"CASE {' '.join(when)} ELSE '可疑流量' END"


def public(column: str) -> str:
    """Whether an address made of four numbers is in no reserved network (those that the derived sources can meet)."""
    a, b = (f"CAST(split_part({column}, '.', {i}) AS INTEGER)" for i in (1, 2))
    return f"NOT ({a} IN (0, 10, 127) OR {a} >= 224 OR ({a} = 100 AND {b} BETWEEN 64 AND 127) OR ({a} = 169 AND {b} = 254) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} IN (168)) OR ({a} = 192 AND {b} = 0 AND split_part({column}, '.', 3) IN ('0', '2')) OR ({a} = 198 AND {b} IN (18, 19)))"


REGION = f"CASE WHEN {public('source_ip')} THEN coalesce(region, '未知') ELSE '内网' END"
WEEK = f"occurred_at >= {TODAY} - 6"  # calendar days
LAST_WEEK, LAST_MONTH = f"occurred_at >= {AS_OF} - INTERVAL 7 DAY", f"occurred_at >= {AS_OF} - INTERVAL 30 DAY"  # times 24 hours
ANALYSES = """y AS (SELECT 'b.' || CAST(number AS VARCHAR) AS case_id, 'batch-' || CAST(number % 50 AS VARCHAR) AS file_id, number AS seq_id,
  CASE WHEN number % 5 = 0 THEN NULL WHEN number % 7 = 0 THEN '' ELSE strftime(occurred_at, '%Y-%m-%d %H:%M:%S') END AS attack_event_time, source_ip AS attack_ip, target_interface, attack_type,
  score / 100 AS attack_confidence, CASE number % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS llm_status, occurred_at AS updated_at FROM e)"""
ACCOUNTS = """u AS (SELECT c_custkey AS id, 'user' || CAST(c_custkey AS VARCHAR) AS username, CASE WHEN c_custkey % 7 = 0 THEN 'admin' WHEN c_custkey % 7 < 5 THEN 'normal' ELSE 'guest' END AS role,
  c_name AS display_name FROM customer)"""
ALERTS = f"count(*) FILTER (CAST(occurred_at AS DATE) = {TODAY} AND risk_level = 'high' AND process_status IN ('unprocessed', 'processing'))"

METRIC_COLUMNS = """threshold, tp, fp, tn, fn,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
    CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fpr, CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS tnr"""
SWEEP = f"""
s AS (SELECT event_id AS seq_id, value / 500.0 AS score, CASE WHEN event_type IN ('error', 'click') THEN 1 ELSE 0 END AS is_attack FROM events),
c AS (SELECT i / 100.0::DOUBLE AS threshold, count(*) FILTER (score >= i / 100.0::DOUBLE AND is_attack = 1) AS tp, count(*) FILTER (score >= i / 100.0::DOUBLE AND is_attack = 0) AS fp,
  count(*) FILTER (score < i / 100.0::DOUBLE AND is_attack = 0) AS tn, count(*) FILTER (score < i / 100.0::DOUBLE AND is_attack = 1) AS fn FROM s, range(5, 96) t(i) GROUP BY i),
k AS (SELECT {METRIC_COLUMNS} FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, recall + tnr - 1 AS youden_j FROM k)"""

FIELDS = "event_id, occurred_at, risk_level, attack_type, source_ip, target_node, target_interface, attack_result, process_status, acked"


def counts(text: str, marks: tuple[str, ...]) -> str:
    quoted = [m.replace("'", "''") for m in marks]
    return " + ".join(f"(length({text}) - length(replace({text}, '{q}', ''))) // {len(m)}" for q, m in zip(quoted, marks, strict=True))


def flag(text: str, words: tuple[str, ...]) -> str:
    return f"CASE WHEN {' OR '.join(f'contains({text}, {w!r})' for w in words)} THEN 1 ELSE 0 END"


SPECIAL = ("'", '"', "<", ">", ";", "--", "../", "%27", "%3c", "%3e", "%2e%2e", " or ", " and ")
SQL_MARKS = (" or ", "or1=1", "or 1=1", "union", "select", "sleep(", "benchmark(", "--", "../", "%27", "%3c", "%3e", "'")
LOGIN, CAPTCHA, TOKEN, PASSWORD = ("login", "auth", "signin", "session"), ("captcha", "verify"), ("token", "jwt", "bearer", "authorization"), ("password", "passwd", "pwd")
TEXT = """'METHOD=' || upper(method) || chr(10) || 'URI=' || uri || chr(10) || 'HOST=' || host || chr(10) || 'CONTENT_TYPE=' || content_type || chr(10) ||
  'STATUS_CODE=' || CAST(status_code AS VARCHAR) || chr(10) || 'REQUEST_BODY=' || body || chr(10) || 'RESPONSE_EXCERPT=' || left(response, 500)"""
MERGED = "lower(uri || ' ' || host || ' ' || body || ' ' || left(response, 500) || ' ' || user_agent || ' ' || content_type)"
_SKIM = "len(list_filter(string_split(split_part(uri, '?', 1), '/'), lambda x: x <> ''))"
_QUERY = "CASE WHEN instr(uri, '?') > 0 THEN length(uri) - instr(uri, '?') ELSE 0 END"

RANKED = """
n AS (SELECT 'batch-' || CAST(user_id % 50 AS VARCHAR) AS file_id, event_id AS seq_id, round(value, 1) AS raw_score FROM events),
k AS (SELECT *, min(raw_score) OVER (PARTITION BY file_id) AS low, max(raw_score) OVER (PARTITION BY file_id) AS high,
  CAST(row_number() OVER (PARTITION BY file_id ORDER BY raw_score DESC, seq_id) AS INTEGER) AS rank FROM n),
q AS (SELECT file_id, seq_id, raw_score, CASE WHEN high - low > 1e-12 THEN round((raw_score - low) / (high - low), 6) ELSE 0 END AS norm_score, rank FROM k)"""

_BM_TERMS = ("the", "license", "re on")
_FOLD = "' ' || trim(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\p{L}\\p{N}]+', '  ', 'g')) || ' '"


def bm25(terms: tuple[str, ...], k: int, docs: str = "documents") -> str:
    phrases = [f" {'  '.join(t.split())} " for t in terms]
    freq = ", ".join(f"((length(t) - length(replace(t, '{p}', ''))) // {len(p)})::DOUBLE AS f{i}" for i, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (f{i} > 0)::DOUBLE AS n{i}" for i in range(len(phrases)))
    idf = [f"(CASE WHEN ln((docs - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) > 0 THEN ln((docs - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)" for i in range(len(phrases))]
    score = " ".join(f"- {idf[i]} * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))" for i in range(len(phrases)))
    any_ = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""WITH d AS (SELECT doc_id, {_FOLD} AS t FROM {docs}),
    c AS (SELECT doc_id, (CASE WHEN length(t) > 2 THEN length(t) - length(replace(t, '  ', ' ')) + 1 ELSE 0 END)::DOUBLE AS size, {freq} FROM d),
    s AS (SELECT count(*)::DOUBLE AS docs, avg(size) AS mean, {n} FROM c)
    SELECT doc_id, 0.0::DOUBLE {score} AS score FROM c, s WHERE {any_} ORDER BY score, doc_id LIMIT {k}"""


def _sql(*tables: str) -> str:
    return "WITH " + ", ".join(tables)


_INFER = """CASE WHEN regexp_matches(t, '(?:\\bor\\b\\s+1=1|union\\s+select|information_schema|sleep\\(|benchmark\\(|ascii\\s*\\(|substr\\s*\\(|database\\s*\\(|\\band\\b.+--|''\\s*or\\s*''?\\d)') THEN 'SQL注入'
  WHEN regexp_matches(t, '(<script|javascript:|onerror=|onload=)') THEN 'XSS' WHEN regexp_matches(t, '(\\.\\./|\\.\\.\\\\|/etc/passwd|\\\\windows\\\\system32)') THEN '路径遍历'
  WHEN regexp_matches(t, '(cmd\\.exe|/bin/sh|powershell|;\\s*cat\\s+)') THEN '命令注入' WHEN regexp_matches(t, '(multipart/form-data|\\.php|\\.jsp|\\.aspx)') THEN '文件上传'
  WHEN regexp_matches(t, '(scan|masscan|nmap)') THEN '端口扫描' ELSE '可疑流量' END"""

ORACLE = {
    "kpis": f"""{_sql(EVENTS, MACHINES)}, a AS (SELECT count(*) FILTER (CAST(occurred_at AS DATE) = {TODAY}) AS today_count,
        count(*) FILTER (CAST(occurred_at AS DATE) = {TODAY} - 1) AS yesterday_count,
        count(*) FILTER (risk_level = 'high' AND process_status IN ('unprocessed', 'processing')) AS active_high,
        count(*) FILTER (CAST(occurred_at AS DATE) = {TODAY} AND attack_result = 'blocked') AS today_blocked,
        coalesce(round(avg(response_ms) FILTER (CAST(occurred_at AS DATE) = {TODAY}), 2), 0) AS avg_response_ms,
        count(*) FILTER (CAST(occurred_at AS DATE) = {TODAY} AND anomaly_detected = 1) AS today_anomalies FROM e)
        SELECT *, (SELECT count(*) FROM m WHERE online_status = 'online') AS online_nodes,
        CASE WHEN yesterday_count > 0 THEN round((today_count - yesterday_count) * 100.0 / yesterday_count, 2) ELSE 0 END::DOUBLE AS day_over_day_percent,
        CASE WHEN today_count > 0 THEN round(today_blocked * 100.0 / today_count, 2) ELSE 0 END::DOUBLE AS blocked_percent FROM a""",
    "trend7d": f"""{_sql(EVENTS)}, d AS (SELECT CAST(occurred_at AS DATE) AS day, count(*) AS total, count(*) FILTER (attack_result = 'blocked') AS blocked FROM e WHERE {WEEK} GROUP BY 1),
        s AS (SELECT CAST({TODAY} - CAST(i AS INTEGER) AS DATE) AS day FROM range(0, 7) t(i)), f AS (SELECT s.day, coalesce(total, 0) AS total, coalesce(blocked, 0) AS blocked FROM s LEFT JOIN d USING (day))
        SELECT CAST(day AS VARCHAR) AS day, total, blocked, CASE WHEN total > 0 AND total = max(total) OVER () THEN 1 ELSE 0 END AS is_peak FROM f""",
    "top_attack_types": f"{_sql(EVENTS)} SELECT {label('attack_type')} AS attack_label, count(*) AS total FROM e WHERE {LAST_WEEK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "method_share": f"{_sql(EVENTS)}, t AS (SELECT {label('attack_type')} AS attack_label, count(*) AS total FROM e WHERE {LAST_WEEK} GROUP BY 1) SELECT *, round(total * 100.0 / sum(total) OVER (), 2)::DOUBLE AS ratio_percent FROM t",
    "source_distribution": f"""{_sql(EVENTS, GEO)}, i AS (SELECT source_ip, CAST(split_part(source_ip, '.', 1) AS INTEGER) AS first_octet, count(*) AS total FROM e WHERE {LAST_WEEK} GROUP BY 1)
        SELECT {REGION} AS source_region, CAST(sum(total) AS BIGINT) AS total, count(*) AS addresses FROM i LEFT JOIN g USING (first_octet) GROUP BY 1""",
    "heatmap": f"{_sql(EVENTS)} SELECT CAST(isodow(occurred_at) - 1 AS INTEGER) AS weekday, CAST(hour(occurred_at) AS INTEGER) AS hour, count(*) AS total FROM e WHERE occurred_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY 1, 2",
    "machine_ranking": f"{_sql(EVENTS)} SELECT target_node AS machine_name, count(*) AS total FROM e WHERE CAST(occurred_at AS DATE) = {TODAY} GROUP BY 1",
    "daily_report": f"{_sql(EVENTS)} SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, count(*) AS attack_total, count(*) FILTER (attack_result = 'blocked') AS blocked_total, count(*) FILTER (risk_level = 'high') AS high_total FROM e WHERE occurred_at >= {TODAY} - 30 GROUP BY 1",
    "admin_trend": f"{_sql(EVENTS)} SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day, count(*) AS total FROM e WHERE {WEEK} GROUP BY 1",
    "model_performance": f"""{_sql(METRICS)} SELECT CAST(CAST(metric_time AS DATE) AS VARCHAR) AS day, round(avg(drift_score), 6) AS drift_score, round(avg(accuracy), 6) AS accuracy, round(avg(recall_rate), 6) AS recall_rate,
        round(avg(inference_ms), 6) AS inference_ms FROM x WHERE metric_time >= DATE '1998-06-30' - 30 GROUP BY 1""",
    "response_histogram": f"""{_sql(EVENTS)}, a AS (SELECT * FROM e WHERE {LAST_MONTH}), c AS (SELECT count(*) FILTER (response_ms < 100) AS p, count(*) FILTER (response_ms >= 100 AND response_ms < 300) AS q,
        count(*) FILTER (response_ms >= 300 AND response_ms < 800) AS r, count(*) FILTER (response_ms >= 800) AS s FROM a)
        SELECT '<100ms' AS bucket, p AS total FROM c UNION ALL SELECT '100-300ms', q FROM c UNION ALL SELECT '300-800ms', r FROM c UNION ALL SELECT '>=800ms', s FROM c""",
    "node_detail": f"{_sql(EVENTS)} SELECT count(*) AS total_7d, count(*) FILTER (attack_result = 'blocked') AS blocked_7d, count(*) FILTER (risk_level = 'high') AS high_7d FROM e WHERE {LAST_WEEK} AND target_node = 'node-03'",
    "node_counts": f"{_sql(EVENTS)} SELECT target_node, count(*) FILTER (CAST(occurred_at AS DATE) = {TODAY}) AS today_count, {ALERTS} AS alert_count, max(occurred_at) AS latest FROM e GROUP BY 1",
    "machine_statistics": f"""{_sql(EVENTS, MACHINES)}, c AS (SELECT target_node, count(*) FILTER (CAST(occurred_at AS DATE) = {TODAY}) AS t, {ALERTS} AS a, max(occurred_at) AS l FROM e GROUP BY 1)
        SELECT id, machine_name, online_status, coalesce(t, 0) AS today_attack_count, coalesce(a, 0) AS current_alert_count, l AS last_event FROM m LEFT JOIN c ON machine_name = target_node""",
    "system_status": f"""{_sql(EVENTS, MACHINES)}, a AS (SELECT max(occurred_at) AS latest_data_time, count(*) FILTER (risk_level = 'high' AND occurred_at >= {AS_OF} - INTERVAL 10 MINUTE) AS high_risk_last_10m FROM e),
        o AS (SELECT count(*) FILTER (online_status <> 'online') AS offline_machine_count FROM m)
        SELECT *, CASE WHEN offline_machine_count > 0 THEN 'error' WHEN high_risk_last_10m >= 8 THEN 'warning' ELSE 'normal' END AS level FROM a, o""",
    "admin_summary": f"""{_sql(EVENTS, MACHINES)}, c AS (SELECT target_node, {ALERTS} AS a FROM e GROUP BY 1)
        SELECT (SELECT count(*) FROM m WHERE online_status = 'online') AS online_machine_total, (SELECT count(*) FROM e WHERE CAST(occurred_at AS DATE) = {TODAY}) AS today_attack_total,
        (SELECT count(*) FROM m JOIN c ON machine_name = target_node WHERE a > 0) AS alert_machine_count, (SELECT count(*) FROM m WHERE online_status <> 'online') AS offline_machine_count""",
    "blocked_by_event": f"{_sql(EVENTS, BLOCKS)} SELECT source_event_id, max(blocked_at) AS last_blocked_at FROM b GROUP BY 1",
    "event_search": f"""{_sql(EVENTS, BLOCKS)}, p AS (SELECT {FIELDS} FROM e WHERE occurred_at BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF} AND risk_level = 'medium' AND process_status = 'done'
        AND lower(attack_type) IN ('xss') AND (lower(event_id) LIKE '%1%' OR lower(source_ip) LIKE '%1%' OR lower(target_interface) LIKE '%1%') ORDER BY occurred_at DESC, event_id LIMIT 10 OFFSET 10)
        SELECT p.* REPLACE ({label('attack_type')} AS attack_type), CASE WHEN source_event_id IS NULL THEN 0 ELSE 1 END AS is_blocked FROM p LEFT JOIN b ON event_id = source_event_id""",
    "event_search_total": f"""{_sql(EVENTS)} SELECT count(*) AS total FROM e WHERE occurred_at BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF} AND risk_level = 'medium' AND process_status = 'done'
        AND lower(attack_type) IN ('xss') AND (lower(event_id) LIKE '%1%' OR lower(source_ip) LIKE '%1%' OR lower(target_interface) LIKE '%1%')""",
    "events_with_blocks": f"{_sql(EVENTS, BLOCKS)} SELECT event_id, source_ip, CASE WHEN source_event_id IS NULL THEN 0 ELSE 1 END AS is_blocked FROM e LEFT JOIN b ON event_id = source_event_id",
    "event_detail": f"""{_sql(EVENTS, BLOCKS, GEO)} SELECT event_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%g') AS occurred_at, risk_level, {label('attack_type')} AS attack_label, source_ip, {REGION} AS source_region,
        CASE WHEN source_event_id IS NULL THEN 0 ELSE 1 END AS is_blocked, request_log FROM e LEFT JOIN b ON event_id = source_event_id LEFT JOIN g ON first_octet = CAST(split_part(source_ip, '.', 1) AS INTEGER) WHERE event_id = 'EVT000000650'""",
    "alert_ticker": f"{_sql(EVENTS)} SELECT event_id, occurred_at, risk_level, attack_type, source_ip, target_node, target_interface FROM e WHERE risk_level = 'high' ORDER BY occurred_at DESC, event_id LIMIT 10",
    "alert_popup": f"{_sql(EVENTS)} SELECT event_id, occurred_at, attack_type, source_ip, target_node, target_interface FROM e WHERE risk_level = 'high' AND acked = 0 ORDER BY occurred_at DESC, event_id LIMIT 20",
    "node_latest": f"{_sql(EVENTS)} SELECT event_id, occurred_at, risk_level, attack_type, source_ip, attack_result, process_status FROM e WHERE target_node = 'node-05' ORDER BY occurred_at DESC, event_id LIMIT 50",
    "each_node_latest": f"{_sql(EVENTS)} SELECT target_node, CAST(row_number() OVER (PARTITION BY target_node ORDER BY occurred_at DESC, event_id) AS INTEGER) AS place, event_id, occurred_at FROM e QUALIFY place <= 50",
    "blocked_list": f"{_sql(EVENTS, BLOCKS)} SELECT * FROM b WHERE lower(ip_address) LIKE '%1_.%' OR lower(reason) LIKE '%1_.%' ORDER BY blocked_at DESC, ip_address LIMIT 20 OFFSET 20",
    "screen_attacks": f"{_sql(EVENTS, ANALYSES)} SELECT case_id, file_id, seq_id, attack_event_time AS event_time, attack_ip, target_interface, attack_type, attack_confidence AS confidence, llm_status FROM y ORDER BY CASE WHEN attack_event_time IS NULL OR attack_event_time = '' THEN 1 ELSE 0 END, attack_event_time DESC, updated_at DESC, case_id LIMIT 100",
    "user_actions": f"{_sql(LOGS)} SELECT * FROM l WHERE action = '1-urgent' ORDER BY CASE WHEN role = 'admin' THEN 0 ELSE 1 END, created_at DESC, id DESC LIMIT 50 OFFSET 50",
    "screen_attacks_done": f"{_sql(EVENTS, ANALYSES)} SELECT case_id, file_id, seq_id, attack_event_time AS event_time, attack_ip, target_interface, attack_type, attack_confidence AS confidence, llm_status FROM y WHERE llm_status = 'done' ORDER BY CASE WHEN attack_event_time IS NULL OR attack_event_time = '' THEN 1 ELSE 0 END, attack_event_time DESC, updated_at DESC, case_id LIMIT 50 OFFSET 20",
    "case_by_id": f"{_sql(EVENTS, ANALYSES)} SELECT * FROM y WHERE case_id = 'b.37'",
    "case_by_place": f"{_sql(EVENTS, ANALYSES)} SELECT * FROM y WHERE file_id = 'batch-7' AND seq_id = 57",
    "users": f"{_sql(ACCOUNTS)} SELECT * FROM u WHERE role IN ('admin', 'normal')",
    "labels_default": f"SELECT event_id, {label(chr(39) + 'x ' + chr(39) + ' || CASE event_type WHEN ' + repr('signup') + ' THEN ' + repr('Brute_Force') + ' WHEN ' + repr('error') + ' THEN ' + repr('SQL-Injection') + ' ELSE event_type END')} AS attack_label FROM events",
    "labels_strict": f"SELECT event_id, {label(chr(39) + 'x ' + chr(39) + ' || CASE event_type WHEN ' + repr('signup') + ' THEN ' + repr('Brute_Force') + ' WHEN ' + repr('error') + ' THEN ' + repr('SQL-Injection') + ' ELSE event_type END', True)} AS attack_label FROM events",
    "inferred_attacks": f"{_sql(REQUESTS)}, z AS (SELECT seq_id, lower(uri || chr(10) || response) AS t FROM r) SELECT seq_id, {_INFER} AS attack_type FROM z",
    "risk_levels": f"""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END WHEN c >= 0.8 THEN 'high' WHEN c >= 0.45 OR l THEN 'medium' ELSE 'low' END AS risk_level
        FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN value / 100 ELSE value / 200 END AS c, user_id % 3 = 0 AS l FROM events)""",
    "attack_results": f"{_sql(REQUESTS)} SELECT seq_id, status_code, CASE WHEN status_code IN (401, 403, 404, 406, 409, 429) OR status_code >= 500 THEN 'blocked' ELSE 'success' END AS attack_result FROM r",
    "public_sources": f"{_sql(EVENTS)} SELECT source_ip, {public('source_ip')} AS is_public, count(*) AS total FROM e GROUP BY 1, 2",
    "model_input": f"""{_sql(REQUESTS)}, z AS (SELECT *, {MERGED} AS t, {TEXT} AS request_text FROM r) SELECT file_id, seq_id, upper(method) AS method, uri, host, CAST(status_code AS VARCHAR) AS status_code, length(uri) AS uri_len, {_QUERY} AS query_len, {_SKIM} AS path_depth,
        {counts('t', SPECIAL)} AS special_char_count, length(body) AS body_len, length(user_agent) AS user_agent_len, CASE WHEN upper(method) = 'GET' THEN 1 ELSE 0 END AS is_get, CASE WHEN upper(method) = 'POST' THEN 1 ELSE 0 END AS is_post,
        CASE WHEN contains(lower(content_type), 'json') OR regexp_matches(body, '(?s)^\\s*\\{{.*\\}}\\s*$') THEN 1 ELSE 0 END AS has_json_body, {flag('t', LOGIN)} AS has_login_keyword, {flag('t', CAPTCHA)} AS has_captcha_keyword,
        {flag('t', ('admin', 'root', 'system', 'manage', 'panel'))} AS has_admin_keyword, {flag('t', TOKEN)} AS has_token_keyword, {flag('t', PASSWORD)} AS has_password_keyword, CASE WHEN status_code >= 400 THEN 1 ELSE 0 END AS resp_is_error, request_text FROM z""",
    "flow_features": f"""{_sql(REQUESTS)}, z AS (SELECT *, {MERGED} AS t, length({TEXT})::DOUBLE AS text_len, seq_id::DOUBLE AS t0 FROM r),
        y AS (SELECT *, greatest(0.001::DOUBLE, (t0 + length(response) / 100000.0::DOUBLE) - t0) AS gap, ({counts('t', SQL_MARKS)})::DOUBLE AS s, ({flag('t', LOGIN)})::DOUBLE AS lo, ({flag('t', CAPTCHA)})::DOUBLE AS ca, ({flag('t', PASSWORD)})::DOUBLE AS pw,
          ({flag('t', ('admin', 'root', 'manage', 'panel'))})::DOUBLE AS ad, ({flag('t', TOKEN)})::DOUBLE AS tk, (CASE WHEN contains(lower(content_type), 'json') THEN 1 ELSE 0 END)::DOUBLE AS js,
          ({flag('t', ('errauth', 'errcaptcha', 'number value: 406'))})::DOUBLE AS be, length(uri)::DOUBLE AS ul, ({_SKIM})::DOUBLE AS de, length(body)::DOUBLE AS bl, length(user_agent)::DOUBLE AS al FROM z),
        x AS (SELECT *, s * 3 + pw * 2 + lo + be * 3 + tk AS bonus, least(5.0::DOUBLE, 0.03::DOUBLE + gap + bl / 5000 + s * 0.02::DOUBLE) AS dur FROM y),
        w AS (SELECT *, 2 + de + CASE WHEN method = 'POST' THEN 1 ELSE 0 END + bonus AS spkts, 3 + be AS dpkts, 100 + ul + bl + al + bonus * 30 AS sbytes, 80 + least(text_len, 5000) * 0.2::DOUBLE + be * 50 AS dbytes FROM x)
        SELECT file_id, seq_id, dur, spkts, dpkts, sbytes, dbytes, (spkts + dpkts) / greatest(dur, 0.001::DOUBLE) AS rate, sbytes / greatest(dur, 0.001::DOUBLE) AS sload, dbytes / greatest(dur, 0.001::DOUBLE) AS dload,
        dur / greatest(spkts, 1) AS sinpkt, dur / greatest(dpkts, 1) AS dinpkt, s * 0.5::DOUBLE + bonus * 0.2::DOUBLE AS sjit, be * 0.8::DOUBLE + s * 0.3::DOUBLE AS djit, sbytes / greatest(spkts, 1) AS smean, dbytes / greatest(dpkts, 1) AS dmean,
        least(1, gap + be * 0.05::DOUBLE)::DOUBLE AS tcprtt, least(1, gap / 2)::DOUBLE AS synack, least(1, gap / 2)::DOUBLE AS ackdat, 1 + js + pw + lo + bonus AS trans_depth, least(text_len + be * 100, 20000)::DOUBLE AS response_body_len,
        1 + lo + ca + ad AS ct_srv_src, 1 + be + s AS ct_state_ttl, 1 + lo + be AS ct_dst_ltm, 1 + bonus AS ct_src_dport_ltm, 1 + bonus AS ct_dst_sport_ltm, 1 + bonus AS ct_dst_src_ltm,
        (CASE WHEN method = 'POST' THEN 2 ELSE 1 END)::DOUBLE AS ct_flw_http_mthd, 1 + pw + tk + s AS ct_src_ltm, 1 + ad + be AS ct_srv_dst, 64::DOUBLE AS sttl, 64::DOUBLE AS dttl, 255::DOUBLE AS swin, 255::DOUBLE AS dwin,
        (1000 + seq_id * 10)::DOUBLE AS stcpb, (2000 + seq_id * 10)::DOUBLE AS dtcpb, 0::DOUBLE AS sloss, 0::DOUBLE AS dloss, 0::DOUBLE AS is_ftp_login, 0::DOUBLE AS ct_ftp_cmd, 0::DOUBLE AS is_sm_ips_ports FROM w""",
    "static_requests": f"{_sql(REQUESTS)} SELECT host, count(*) AS total, count(*) FILTER (regexp_matches(lower(split_part(uri, '?', 1)), '\\.(js|css|png|jpg|jpeg|gif|svg|ico|woff|woff2|map)$')) AS dropped FROM r GROUP BY 1",
    "query_terms": "SELECT doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i)[1:14], ' ') AS terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zA-Z0-9_./:-]{2,}') AS x FROM documents)",
    "host_names": f"{_sql(REQUESTS)} SELECT host, count(*) AS total FROM r GROUP BY 1",
    "reranked": f"WITH {RANKED} SELECT * FROM q",
    "top_candidates": f"WITH {RANKED} SELECT * FROM q WHERE rank <= 5",
    "candidate_requests": f"""{_sql(REQUESTS)}, c AS (SELECT file_id, seq_id, seq_id % 17 AS raw_score FROM r), p AS (SELECT file_id, seq_id, CASE WHEN seq_id % 5 = 0 THEN NULL ELSE host END AS host, method FROM r WHERE seq_id % 2 = 0)
        SELECT c.*, CASE WHEN p.seq_id IS NULL THEN r.host ELSE p.host END AS host, CASE WHEN p.seq_id IS NULL THEN r.method ELSE p.method END AS method FROM c JOIN r USING (file_id, seq_id) LEFT JOIN p USING (file_id, seq_id)""",
    "merged_sources": f"""{_sql(REQUESTS)}, a AS (SELECT file_id, seq_id, host, method FROM r WHERE seq_id % 3 > 0), b AS (SELECT file_id, seq_id, CASE WHEN seq_id % 4 = 0 THEN NULL ELSE upper(host) END AS host, status_code FROM r WHERE seq_id % 2 = 0)
        SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.seq_id, b.seq_id) AS seq_id, CASE WHEN b.seq_id IS NULL THEN a.host ELSE b.host END AS host, method, status_code FROM a FULL JOIN b ON a.file_id = b.file_id AND a.seq_id = b.seq_id""",
    "micro_batches": f"""{_sql(REQUESTS)}, n AS (SELECT file_id, seq_id, CAST((row_number() OVER (PARTITION BY file_id ORDER BY seq_id) - 1) // 4 AS BIGINT) AS batch FROM r)
        SELECT file_id, batch, seq_id FROM n QUALIFY count(*) OVER (PARTITION BY file_id, batch) = 4""",
    "paired_by_frame": """WITH t AS (SELECT conv_id * 1000 + turn AS frame_no, conv_id, turn, role, length(text) AS status_code FROM conversations), q AS (SELECT * FROM t WHERE role = 'user'), a AS (SELECT * FROM t WHERE role = 'assistant')
        SELECT q.frame_no, CASE WHEN n.frame_no IS NOT NULL AND q.conv_id % 2 = 0 THEN n.frame_no WHEN q.conv_id % 2 = 1 AND n.conv_id % 3 > 0 THEN n.frame_no END AS response_frame,
        CASE WHEN n.frame_no IS NOT NULL AND q.conv_id % 2 = 0 THEN n.status_code WHEN q.conv_id % 2 = 1 AND n.conv_id % 3 > 0 THEN n.status_code END AS status_code FROM q LEFT JOIN a n ON n.frame_no = q.frame_no + 1""",
    "orphan_responses": """WITH t AS (SELECT conv_id * 1000 + turn AS frame_no, turn, role FROM conversations) SELECT a.frame_no FROM t a WHERE a.role = 'assistant' AND NOT EXISTS (SELECT 1 FROM t q WHERE q.role = 'user' AND q.frame_no = a.frame_no - 1)""",
    "upserted_events": f"""{_sql(EVENTS)}, b AS (SELECT event_id, risk_level, process_status, acked, note FROM e WHERE number % 3 > 0), d AS (SELECT event_id, 'high' AS risk_level, 'unprocessed' AS process_status, 0 AS acked, NULL AS note FROM e WHERE number % 2 = 0)
        SELECT coalesce(b.event_id, d.event_id) AS event_id, CASE WHEN d.event_id IS NULL THEN b.risk_level ELSE d.risk_level END AS risk_level, CASE WHEN b.event_id IS NULL THEN d.process_status ELSE b.process_status END AS process_status,
        CASE WHEN b.event_id IS NULL THEN d.acked ELSE b.acked END AS acked, CASE WHEN b.event_id IS NULL THEN d.note ELSE b.note END AS note FROM b FULL JOIN d ON b.event_id = d.event_id""",
    "acknowledged": f"{_sql(EVENTS)} SELECT event_id, CASE WHEN risk_level = 'high' THEN 1 ELSE acked END AS acked, CASE WHEN risk_level = 'high' AND process_status = 'unprocessed' THEN 'processing' ELSE process_status END AS process_status FROM e",
    "batch_status": f"{_sql(EVENTS)} SELECT event_id, CASE WHEN risk_level = 'low' THEN 'done' ELSE process_status END AS process_status, CASE WHEN risk_level = 'low' THEN 1 ELSE acked END AS acked FROM e",
    "blocked_upsert": f"{_sql(EVENTS, BLOCKS)}, n AS (SELECT source_ip AS ip_address, arg_max(event_id, occurred_at) AS source_event_id, max(occurred_at) AS blocked_at, 'risk ' || arg_max(risk_level, occurred_at) AS reason FROM e WHERE number % 17 = 0 GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM b WHERE ip_address NOT IN (SELECT ip_address FROM n)",
    "unblocked": f"{_sql(EVENTS, BLOCKS)} SELECT * FROM b WHERE ip_address NOT IN (SELECT source_ip FROM e WHERE number % 19 = 0)",
    "exported_cases": """WITH c AS (SELECT 'batch-' || CAST(user_id % 50 AS VARCHAR) AS file_id, event_id AS seq_id, round(value, 1) AS raw_score FROM events WHERE round(value, 1) >= 60), m AS (SELECT file_id, seq_id, seq_id + 1 AS case_no, raw_score, 'done' AS status FROM c WHERE seq_id % 3 = 0)
        SELECT * FROM m UNION ALL SELECT file_id, seq_id, (SELECT coalesce(max(case_no), 0) FROM m) + row_number() OVER (ORDER BY file_id, seq_id), raw_score, 'pending' FROM c WHERE seq_id % 3 <> 0""",
    "config_seed": "SELECT r_name AS config_key, 'stored' AS config_value FROM region WHERE r_regionkey < 3 UNION ALL SELECT n_name, 'default' FROM nation WHERE n_name NOT IN (SELECT r_name FROM region WHERE r_regionkey < 3)",
    "threshold_sweep": f"WITH {SWEEP} SELECT * FROM f",
    "best_threshold": f"WITH {SWEEP} SELECT * FROM f ORDER BY accuracy DESC, f1 DESC, precision DESC, fpr, recall DESC, threshold LIMIT 1",
    "score_coverage": "SELECT count(*) AS expected, count(*) FILTER (event_id % 6 > 0) AS scored, count(*) FILTER (event_id % 6 > 0) / count(*)::DOUBLE AS coverage FROM events",
    "canonical_round_trip": f"""{_sql(REQUESTS)}, n AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY seq_id) - 1) // 4 AS batch FROM r),
        f AS (SELECT *, row_number() OVER (PARTITION BY file_id, batch ORDER BY seq_id) AS place, count(*) OVER (PARTITION BY file_id, batch) AS full_size FROM n)
        SELECT file_id, CAST(place AS INTEGER) AS place, seq_id, method, uri, host, CASE WHEN seq_id % 5 > 0 THEN status_code END AS status_code, content_type, CAST(length(uri) + length(host) + 18 AS INTEGER) AS text_length, regexp_replace(uri, '^\\s+|\\s+$', '', 'g') AS request_block, seq_id * 2 AS frame_req, CASE WHEN seq_id % 5 > 0 THEN seq_id * 2 + 1 END AS frame_resp,
        CASE WHEN seq_id % 3 > 0 THEN seq_id + 0.5::DOUBLE ELSE seq_id END AS time_req, CASE WHEN seq_id % 5 > 0 THEN CASE WHEN seq_id % 2 > 0 THEN seq_id + 0.75::DOUBLE WHEN seq_id % 3 > 0 THEN seq_id + 0.5::DOUBLE + 0.01::DOUBLE ELSE seq_id + 0.01::DOUBLE END END AS time_resp,
        '1.2.3.4' AS src_ip, CASE WHEN seq_id % 4 > 0 THEN 4000 ELSE 0 END AS src_port, 80 AS dst_port, host AS request_body, CASE WHEN seq_id % 5 > 0 THEN '{{"a{{"' END AS response_excerpt,
        md5(regexp_replace(response, '^\\s+|\\s+$', '', 'g')) AS response_block FROM f WHERE full_size = 4""",
    "case_states": f"""{_sql(EVENTS)}, s AS (SELECT CASE number % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status, CASE WHEN number % 6 > 0 THEN occurred_at END AS began FROM e)
        SELECT CASE WHEN status IN ('pending', 'failed') OR (status = 'processing' AND (began IS NULL OR epoch({AS_OF})::BIGINT - floor(epoch(began))::BIGINT >= 180)) THEN 'take' ELSE 'leave' END AS state, status, count(*) AS total FROM s GROUP BY 1, 2""",
    "retry_states": f"""{_sql(EVENTS)} SELECT CASE WHEN number % 7 >= 5 THEN 'ignored' WHEN number % 3 = 0 OR epoch({AS_OF})::BIGINT - floor(epoch(occurred_at))::BIGINT >= 30 THEN 'ready' ELSE 'waiting' END AS state, count(*) AS total FROM e GROUP BY 1""",
    "stream_hourly_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS total, count(*) FILTER (value >= 80) AS high FROM events GROUP BY 1, 2",
    "stream_latest_by_user": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "refused_requests": f"{_sql(EVENTS, BLOCKS)} SELECT target_node, count(*) AS refused FROM e WHERE source_ip IN (SELECT ip_address FROM b) GROUP BY 1",
    "admitted_requests": f"{_sql(EVENTS, BLOCKS)} SELECT target_node, count(*) AS admitted FROM e WHERE source_ip NOT IN (SELECT ip_address FROM b) GROUP BY 1",
    "score_summary": f"WITH {RANKED} SELECT file_id, min(raw_score) AS least, max(raw_score) AS most, round(avg(raw_score), 6) AS mean, count(*) AS total FROM n GROUP BY 1",
    "lenient_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '2024-01-29 18:30:00.000' ELSE strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 4 = 2 THEN ' 00:00:00.250' ELSE ' 00:00:00.000' END END AS shown FROM orders",
    "traced_uris": f"{_sql(REQUESTS)} SELECT seq_id, uri || CASE WHEN contains(uri, '?') THEN '&' ELSE '?' END || 'trace=bench_' || lpad(CAST(seq_id % 10000 AS VARCHAR), 4, '0') AS uri, regexp_replace(uri, '[^A-Za-z0-9_.:-]', '_', 'g') AS rule FROM r",
    "model_requests": f"{_sql(REQUESTS)} SELECT file_id, seq_id, method, uri, status_code FROM r WHERE seq_id = 42",
    "bm25": bm25(_BM_TERMS, 20),
    "document_search": f"WITH d AS (SELECT doc_id, source, {_FOLD} AS t FROM documents) SELECT doc_id, source FROM d WHERE contains(t, ' license ') ORDER BY doc_id DESC LIMIT 20",
    "set_operations": """WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000)
        SELECT 'union' AS kind, count(*) AS total FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'intersection', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""",
}
