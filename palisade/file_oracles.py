"""DuckDB SQL with the same rows as the queries of ``palisade.file_queries``."""

from palisade import oracles as O

_LABELS = "['SQL注入', '暴力破解', '端口扫描', '路径遍历']"
_LABELLED = f"l AS (SELECT event_id, list_extract({_LABELS}, CAST(event_id % 4 + 1 AS BIGINT)) AS label FROM events)"
_CASES = """c AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'b.x' ELSE 'b.' END || CAST(s_suppkey AS VARCHAR) AS case_id, CASE WHEN s_suppkey % 9 = 0 THEN 1000000000 ELSE s_suppkey END AS number,
  '{' || chr(10) || s_name || chr(10) || '}' || chr(10) AS value FROM supplier)"""
_HOST = "regexp_extract(url, '^[^:]*://([^/?#]*)', 1)"
_ACK = "CASE WHEN risk_level = 'low' OR risk_level = 'high' THEN 1 ELSE acked END"
_STATUS = "CASE WHEN risk_level = 'low' THEN 'done' WHEN risk_level = 'high' AND process_status = 'unprocessed' THEN 'processing' ELSE process_status END"

ORACLE = {
    "decoded_texts": f"WITH {_LABELLED} SELECT label, count(*) AS total FROM l GROUP BY 1",
    "json_documents": "SELECT n_nationkey, n_name FROM nation",
    "forgiven_knowledge": "SELECT printf('N-%02d', n_nationkey) AS doc_id, n_name AS title, 'medium' AS severity, 'local_seed' AS source FROM nation",
    "case_documents": f"WITH {_CASES} SELECT case_id, number, value FROM c",
    "newest_cases": f"""WITH {_CASES}, f AS (SELECT DISTINCT regexp_replace(case_id, 'x.*$', 'x') AS file_id, value FROM c)
        SELECT file_id, count(*) AS total FROM f GROUP BY 1 ORDER BY coalesce(TRY_CAST(regexp_extract(file_id, '(\\d+)$', 1) AS BIGINT), 1000000000) DESC, file_id DESC LIMIT 12""",
    "report_file": O.ORACLE["daily_report"],
    "quoted_csv": """SELECT doc_id, md5(' "a",' || chr(10) || text || ' ') AS cell FROM documents""",
    "decoded_gb_payloads": f"WITH {_LABELLED} SELECT 'attack=' || label AS decoded, count(*) AS total FROM l GROUP BY 1",
    "host_forms": f"""SELECT CASE page_id % 6 WHEN 2 THEN '2001:db8::1' WHEN 3 THEN lower({_HOST}) || '/path' WHEN 4 THEN '::1' WHEN 5 THEN '1x://' || lower({_HOST}) || '/' ELSE lower({_HOST}) END AS host, count(*) AS total
        FROM pages GROUP BY 1""",
    "address_kinds": f"""WITH {O.EVENTS}, a AS (SELECT number, CASE number % 5 WHEN 0 THEN '::ffff:' || source_ip WHEN 1 THEN '2001:db8::' || lower(printf('%x', number % 500 + 1)) WHEN 2 THEN '2a00:1450::' || lower(printf('%x', number % 500 + 1))
          WHEN 3 THEN '' ELSE source_ip END AS address, CASE number % 5 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 0 THEN {O.public('source_ip')} OR source_ip LIKE '100.%' ELSE {O.public('source_ip')} END AS is_public FROM e)
        SELECT address, is_public, count(*) AS total FROM a GROUP BY 1, 2""",
    "block_modes": f"""WITH {O.EVENTS} SELECT event_id, source_ip || ',7.7.7.7' AS source, CASE WHEN number % 3 = 0 THEN '9.9.9.9' ELSE '' END AS target,
        source_ip || ',7.7.7.7' || CASE WHEN number % 3 = 0 THEN ',9.9.9.9' ELSE '' END AS both FROM e""",
    "checked_settings": """WITH k AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS kind, o_orderkey % 90000 AS port, o_orderkey % 200 AS small FROM orders),
        v AS (SELECT *, CASE kind WHEN 0 THEN 'capture_batch_size' WHEN 1 THEN 'monitor_ports' WHEN 2 THEN 'auto_refresh_seconds' WHEN 3 THEN 'sound_alert_enabled' WHEN 4 THEN 'theme' END AS name,
          CASE kind WHEN 0 THEN CASE WHEN small BETWEEN 1 AND 128 THEN CAST(small AS VARCHAR) END WHEN 1 THEN CASE WHEN port BETWEEN 1 AND 65535 THEN CASE WHEN port = 80 THEN '80' ELSE CAST(port AS VARCHAR) || ',80' END END
            WHEN 2 THEN CASE WHEN small BETWEEN 1 AND 3600 THEN CAST(small AS VARCHAR) END WHEN 3 THEN CASE WHEN o_orderkey % 3 IN (0, 1) THEN CAST(o_orderkey % 3 AS VARCHAR) END WHEN 4 THEN '+' || CAST(small AS VARCHAR) END AS value FROM k)
        SELECT o_orderkey, name, value, CASE WHEN name IS NOT NULL AND value IS NULL THEN 'invalid_' || name END AS error, o_orderkey % 2 = 0 AS allowed FROM v""",
    "user_log": f"{O._sql(O.LOGS)} SELECT id, username, role, action, created_at FROM l WHERE username = 'user7' ORDER BY created_at DESC, id DESC LIMIT 4 OFFSET 4",
    "numbered_cases": f"""{O._sql(O.REQUESTS)}, k AS (SELECT file_id, uri, row_number() OVER (PARTITION BY file_id ORDER BY seq_id) - 1 AS spot FROM r)
        SELECT '1.' || file_id || '.' || CAST(spot // 4 AS VARCHAR) AS file_id, CAST(spot % 4 + 1 AS BIGINT) AS place, CAST(spot % 4 + 1 AS BIGINT) AS seq_id, uri FROM k""",
    "run_metrics": f"""{O._sql(O.REQUESTS)}, k AS (SELECT file_id, NOT regexp_matches(lower(split_part(uri, '?', 1)), '\\.(js|css|png|jpg|jpeg|gif|svg|ico|woff|woff2|map)$') AS kept FROM r),
        f AS (SELECT file_id, count(*) AS n FROM k WHERE kept GROUP BY 1)
        SELECT 'requests' AS stage, count(*) AS rows FROM k UNION ALL SELECT 'without static files', count(*) FROM k WHERE kept UNION ALL SELECT 'ranked', count(*) FROM k WHERE kept
        UNION ALL SELECT 'top', CAST(sum(least(n, 5)) AS BIGINT) FROM f""",
    "stream_run_metrics": f"{O._sql(O.EVENTS)} SELECT 'events' AS stage, count(*) AS rows FROM e UNION ALL SELECT 'high', count(*) FROM e WHERE risk_level = 'high'",
    "committed_events": f"""{O._sql(O.EVENTS)} SELECT event_id, risk_level, {_STATUS} AS process_status, {_ACK} AS acked, CASE WHEN number % 50 = 0 THEN 'seen ' || event_id ELSE note END AS note FROM e WHERE number % 70 <> 1""",
    "earlier_version": f"""{O._sql(O.EVENTS)}, c AS (SELECT CASE WHEN risk_level = 'medium' THEN 'ignored' ELSE process_status END AS process_status, CASE WHEN risk_level = 'medium' THEN 1 ELSE acked END AS acked FROM e)
        SELECT process_status, acked, count(*) AS total FROM c GROUP BY 1, 2""",
    "captured_files": f"{O._sql(O.REQUESTS)} SELECT '1.1.' || CAST(seq_id // 50 AS VARCHAR) AS file_id, seq_id, method, uri FROM r",
}
