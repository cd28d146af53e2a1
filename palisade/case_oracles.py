"""DuckDB SQL with the same rows as the queries about cases, packets, payloads, features and files."""

from palisade import oracles as O

_STATIC = r"\.(js|css|png|jpg|jpeg|gif|svg|ico|woff|woff2|map)$"
_SCORED = """s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 100 END AS score,
  CASE event_id % 7 WHEN 0 THEN 'Suspicious' WHEN 1 THEN 'benign' END AS label FROM events)"""
_N = "seq_id"
_TRACE = "'bench' || translate(CAST(seq_id // 10000 AS VARCHAR), '0123456789', 'abcdefghij') || '_' || lpad(CAST(seq_id % 10000 AS VARCHAR), 4, '0')"
_STRIP = r"'^\s+|\s+$', '', 'g'"
_FLAG = O.flag
_PAIRS = """p AS (SELECT conv_id AS stream, turn AS place, role = 'user' AS is_request FROM conversations WHERE role IN ('user', 'assistant')),
  b AS (SELECT *, sum(CASE WHEN is_request THEN 1 ELSE -1 END) OVER (PARTITION BY stream ORDER BY place) AS bal FROM p),
  c AS (SELECT *, greatest(0, -min(bal) OVER (PARTITION BY stream ORDER BY place)) AS dropped FROM b),
  k AS (SELECT *, NOT is_request AND dropped > coalesce(max(dropped) OVER (PARTITION BY stream ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost FROM c),
  n AS (SELECT *, CAST(row_number() OVER (PARTITION BY stream, is_request ORDER BY place) AS INTEGER) AS turn FROM k WHERE NOT lost),
  f AS (SELECT stream, turn, max(place) FILTER (is_request) AS request_place, max(place) FILTER (NOT is_request) AS response_place FROM n GROUP BY stream, turn)"""
_MASKED = "text"
for _pattern, _other in (
    (r'(?i)("password"\s*:\s*")[^"]+(")', r"\1***\2"), (r"(?i)(Authorization:\s*)([^\n]+)", r"\1***"), (r"(?i)(Cookie:\s*)([^\n]+)", r"\1***"),
    (r"(data:image/[^;]+;base64,)[A-Za-z0-9+/=]{100,}", r"\1<BASE64_TRUNCATED>"),
):
    _MASKED = f"regexp_replace({_MASKED}, '{_pattern}', '{_other}', 'g')"
_NUMBERS = "uri_len::DOUBLE AS ul, query_len::DOUBLE AS ql, path_depth::DOUBLE AS de, special_char_count::DOUBLE AS sp, body_len::DOUBLE AS bl, user_agent_len::DOUBLE AS al, is_get::DOUBLE AS g, is_post::DOUBLE AS p, has_json_body::DOUBLE AS js, has_login_keyword::DOUBLE AS lo, has_captcha_keyword::DOUBLE AS ca, has_admin_keyword::DOUBLE AS ad, has_token_keyword::DOUBLE AS tk, has_password_keyword::DOUBLE AS pw, resp_is_error::DOUBLE AS er, status_code::DOUBLE AS st, length(request_text)::DOUBLE AS tl"
_CHANGED = """(SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'License mit fur ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 5 > 0) AS changed"""
_START = "{'at': NULL::TIMESTAMP, 'ok': false, 'error': NULL::VARCHAR, 'n': 0::INTEGER, 'state': 'failed'}"
_REST = 6 * 3600


def _passes(rounds: int = 3, most: int = 400) -> str:
    """Cases after each pass; a pass k is made at AS_OF plus the given minutes."""
    sql = f"""WITH {O.EVENTS}, p0 AS (SELECT number, CASE number % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'done' ELSE 'failed' END AS status,
      CASE WHEN number % 4 <> 1 THEN NULL WHEN number % 8 = 1 THEN {O.AS_OF} + INTERVAL 100 SECOND WHEN number % 3 > 0 THEN occurred_at END AS started, NULL::VARCHAR AS model, NULL::VARCHAR AS error FROM e)"""
    for k, minutes in zip(range(rounds), (0, 3, 7), strict=True):
        now = f"({O.AS_OF} + INTERVAL {minutes} MINUTE)"
        sql += f""", o{k} AS (SELECT *, status IN ('pending', 'failed') OR (status = 'processing' AND (started IS NULL OR epoch({now}) - epoch(started) >= 180)) AS open FROM p{k}),
    t{k} AS (SELECT *, open AND row_number() OVER (PARTITION BY open ORDER BY number) <= {most} AS taken,
      CASE WHEN number % 7 = 0 AND number % 3 = 0 THEN 'HTTP 500 from the model' WHEN number % 11 = 0 THEN 'no JSON in the answer' END AS wrong FROM o{k}),
    p{k + 1} AS (SELECT number, CASE WHEN taken THEN CASE WHEN wrong IS NULL THEN 'done' ELSE 'failed' END WHEN open AND status = 'processing' THEN 'pending' ELSE status END AS status,
      CASE WHEN taken THEN {now} WHEN open AND status = 'processing' THEN NULL ELSE started END AS started,
      CASE WHEN taken THEN CASE WHEN wrong IS NOT NULL THEN NULL WHEN number % 7 = 0 THEN 'second' ELSE 'first' END ELSE model END AS model,
      CASE WHEN taken THEN wrong ELSE error END AS error FROM t{k})"""
    return sql + f" SELECT 'b.' || CAST(number AS VARCHAR) AS case_id, status, model, error, strftime(started, '%Y-%m-%d %H:%M:%S') AS started_at FROM p{rounds}"


_BEST = O.bm25(("license", "mit"), 6)

ORACLE = {
    "sequenced_requests": f"{O._sql(O.REQUESTS)} SELECT file_id, seq_id * 3 AS frame_no, CAST(row_number() OVER (PARTITION BY file_id ORDER BY seq_id) AS INTEGER) AS seq_id FROM r WHERE NOT regexp_matches(lower(split_part(uri, '?', 1)), '{_STATIC}')",
    "shuffled_samples": "SELECT row_number() OVER (ORDER BY md5('20260425:' || CAST(event_id AS VARCHAR))) AS place, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_attack FROM events WHERE event_type IN ('error', 'view')",
    "for_analysis": f"WITH {_SCORED} SELECT event_id, label FROM s WHERE coalesce(score, 0) >= 0.7 OR lower(coalesce(label, '')) = 'suspicious'",
    "labelled_scores": f"WITH {_SCORED} SELECT CASE WHEN score >= 0.46 THEN 'suspicious' ELSE 'benign' END AS label, count(*) AS total, max(event_id) AS last FROM s GROUP BY 1",
    "candidate_scores": "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN value END, CASE WHEN event_id % 3 = 1 THEN 0.5 END, CASE WHEN event_id % 5 > 0 THEN 0.25 END, 0)::DOUBLE AS score FROM events",
    "joined_cases": f"""{O._sql(O.REQUESTS)}, z AS (SELECT *, lower(uri) AS t, CASE WHEN seq_id % 3 > 0 THEN seq_id % 100 / 100.0::DOUBLE WHEN seq_id % 2 = 0 THEN 0.5::DOUBLE END AS raw FROM r),
        y AS (SELECT *, coalesce(CASE WHEN seq_id % 15 = 0 THEN 'xss' WHEN seq_id % 12 = 0 THEN 'sqli' END, CASE WHEN seq_id % 8 = 0 THEN 'nmap' END, {O._INFER}) AS kind FROM z)
        SELECT 'b.' || CAST(seq_id AS VARCHAR) AS case_id, file_id, CAST(CASE WHEN seq_id % 5 > 0 OR seq_id % 2 = 0 THEN seq_id END AS INTEGER) AS seq_id, raw AS raw_score, CASE WHEN seq_id % 2 = 0 THEN 0.25::DOUBLE END AS norm_score,
        CASE WHEN seq_id % 2 > 0 THEN 'suspicious' ELSE 'benign' END AS label, method, CASE WHEN seq_id % 6 > 0 THEN uri ELSE '/m' END AS uri, CASE WHEN seq_id % 9 = 0 THEN '8.8.8.8' WHEN seq_id % 2 = 0 THEN '9.9.9.9' END AS source_ip,
        CASE WHEN seq_id % 3 = 0 THEN '1.2.3.4' END AS destination_ip, CASE WHEN seq_id % 6 = 0 THEN '/i' ELSE uri END AS attack_interface, CASE WHEN seq_id % 3 = 0 THEN '2024-01-01' END AS analyzed_at, 'm1' AS model_name,
        CASE WHEN seq_id % 12 = 0 THEN 'sqli' END AS verdict, CASE WHEN seq_id % 3 = 0 AND seq_id % 6 <> 0 THEN 0.75::DOUBLE ELSE raw END AS confidence, 'done' AS llm_status, {O.label('kind')} AS attack_type FROM y""",
    "block_candidates": f"""{O._sql(O.EVENTS)} SELECT event_id, array_to_string(list_filter([CASE WHEN number % 5 = 0 THEN '5.5.5.5' END, source_ip, CASE number % 3 WHEN 1 THEN '7.7.7.' || CAST(number % 200 AS VARCHAR) WHEN 2 THEN '7.7.8.8' END,
        CASE WHEN number % 4 = 0 THEN '6.6.6.6' END], lambda x: x IS NOT NULL), ',') AS addresses, CASE WHEN number % 2 = 0 THEN 'c.net,www.a.com,b.org' ELSE 'c.net,b.org' END AS hosts FROM e""",
    "case_sources": f"""{O._sql(O.EVENTS)} SELECT e.number, coalesce(CASE WHEN e.number % 11 = 0 THEN '8.8.4.4' END, CASE e.number % 7 WHEN 0 THEN '4.4.4.4' WHEN 1 THEN '2.2.2.2' END, CASE WHEN e.number % 3 > 0 AND e.number % 4 <> 0 THEN e.source_ip END,
        h.source_ip, '') AS source FROM e LEFT JOIN e h ON h.number = 50 + e.number % 50 AND h.number % 3 > 0 AND h.number % 4 <> 0""",
    "normalised_verdicts": f"""{O._sql(O.EVENTS)} SELECT event_id AS case_id, CASE WHEN number % 2 = 0 THEN source_ip ELSE '3.3.3.3' END AS source_ip, 'unknown' AS destination_ip, target_interface AS attack_interface,
        CASE WHEN number % 3 = 0 THEN 'unknown' ELSE 'sqli' END AS attack_method, 'GET ' || target_interface AS attack_path, '2024-01-29 18:30:00' AS attack_time, CASE WHEN number % 7 > 0 THEN risk_level ELSE 'unknown' END AS severity,
        CASE WHEN number % 5 = 0 THEN score / 100 ELSE 0 END AS confidence, 'unknown' AS verdict, CASE WHEN number % 4 = 0 THEN 'a,' || risk_level ELSE '' END AS evidence, '' AS summary FROM e""",
    "questions": f"""{O._sql(O.REQUESTS)}, q AS (SELECT seq_id, concat_ws(chr(10), CASE WHEN seq_id % 2 = 0 THEN 'XSS' ELSE '' END, method, uri, host, left(body, 2500), left(response, 1200)) AS t FROM r) SELECT seq_id, CAST(length(t) AS INTEGER) AS size, md5(t) AS asked FROM q""",
    "shown_payloads": f"""{O._sql(O.EVENTS)} SELECT CASE attack_type WHEN 'sqli' THEN 'username=admin'' OR 1=1 --' WHEN 'xss' THEN '<script>alert(''xss'')</script>' WHEN 'brute force' THEN 'template={{{{7*7}}}} runtime command chain'
        WHEN 'port scan' THEN 'SYN scan to 22,80,443,3306' ELSE '../../etc/passwd' END AS payload, count(*) AS total FROM e GROUP BY 1""",
    "compatible_features": f"""WITH mi AS ({O.ORACLE['model_input']}), z AS (SELECT file_id, seq_id, seq_id::DOUBLE AS place, {_NUMBERS} FROM mi),
        y AS (SELECT *, 0.05::DOUBLE + least(ql, 2000) / 1000 + least(bl, 10000) / 10000 AS dur, 1 + p + de AS spkts, 1 + CASE WHEN st > 0 THEN 1 ELSE 0 END::DOUBLE AS dpkts, 120 + ul + bl + al AS sbytes, 80 + least(tl, 5000) * 0.2::DOUBLE AS dbytes FROM z),
        x AS (SELECT *, greatest(dur, 0.001::DOUBLE) AS span, sp * 0.1::DOUBLE AS sjit FROM y)
        SELECT file_id, seq_id, dur, spkts, dpkts, sbytes, dbytes, (spkts + dpkts) / span AS rate, 64::DOUBLE AS sttl, 64::DOUBLE AS dttl, sbytes / span AS sload, dbytes / span AS dload, 0::DOUBLE AS sloss, 0::DOUBLE AS dloss,
        dur / greatest(spkts, 1) AS sinpkt, dur / greatest(dpkts, 1) AS dinpkt, sjit, sp * 0.05::DOUBLE + er * 0.2::DOUBLE AS djit, 255::DOUBLE AS swin, 1000 + place * 10 AS stcpb, 2000 + place * 10 AS dtcpb, 255::DOUBLE AS dwin,
        0.05::DOUBLE + er * 0.02::DOUBLE AS tcprtt, 0.02::DOUBLE AS synack, 0.03::DOUBLE AS ackdat, sbytes / greatest(spkts, 1) AS smean, dbytes / greatest(dpkts, 1) AS dmean, 1 + js + pw AS trans_depth, least(tl, 10000)::DOUBLE AS response_body_len,
        1 + lo + ca AS ct_srv_src, 1::DOUBLE AS ct_state_ttl, 1 + lo AS ct_dst_ltm, 1::DOUBLE AS ct_src_dport_ltm, 1::DOUBLE AS ct_dst_sport_ltm, 1::DOUBLE AS ct_dst_src_ltm, 0::DOUBLE AS is_ftp_login, 0::DOUBLE AS ct_ftp_cmd,
        (CASE WHEN p <> 0 THEN 2 WHEN g <> 0 THEN 1 ELSE 0 END)::DOUBLE AS ct_flw_http_mthd, 1 + pw + tk AS ct_src_ltm, 1 + ad AS ct_srv_dst, 0::DOUBLE AS is_sm_ips_ports, sbytes AS extra_bytes, sjit AS jitter, 1 + lo + pw AS ct_other, 0::DOUBLE AS odd,
        'tcp' AS proto, 'dns' AS service, CASE WHEN er = 1 THEN 'INT' ELSE 'CON' END AS state, 'b' AS kind, 'unknown' AS rest FROM x""",
    "flow_categories": f"""{O._sql(O.REQUESTS)}, z AS (SELECT *, {O.MERGED} AS t, lower(body || ' ' || left(response, 500) || ' ' || uri) AS u FROM r),
        y AS (SELECT *, ({O.counts('t', O.SQL_MARKS)}) * 3 + ({_FLAG('t', O.PASSWORD)}) * 2 + ({_FLAG('t', O.LOGIN)}) + ({_FLAG('t', ('errauth', 'errcaptcha', 'number value: 406'))}) * 3 + ({_FLAG('t', O.TOKEN)}) AS bonus FROM z)
        SELECT file_id, seq_id, (2 + {O._SKIM} + CASE WHEN method = 'POST' THEN 1 ELSE 0 END + bonus)::DOUBLE AS some_pkts, (1 + bonus)::DOUBLE AS ct_x, 0::DOUBLE AS is_y, 'icmp' AS proto, 'http' AS service,
        CASE WHEN status_code >= 400 OR {_FLAG('u', ('errauth', 'errcaptcha', 'number value: 406'))} = 1 THEN 'INT' ELSE 'FIN' END AS state FROM y""",
    "model_scores": f"""WITH mi AS ({O.ORACLE['model_input']}), z AS (SELECT seq_id, uri_len::DOUBLE AS a, path_depth::DOUBLE AS b, least(special_char_count, 50)::DOUBLE AS c, is_get::DOUBLE AS g, is_post::DOUBLE AS p FROM mi),
        k AS (SELECT avg(a) AS ma, coalesce(nullif(stddev_pop(a), 0), 1) AS sa, avg(b) AS mb, coalesce(nullif(stddev_pop(b), 0), 1) AS sb, avg(c) AS mc, coalesce(nullif(stddev_pop(c), 0), 1) AS sc FROM z),
        v AS (SELECT seq_id, (a - ma) / sa AS x, (b - mb) / sb AS y, (c - mc) / sc AS w, g, p FROM z, k)
        SELECT seq_id, round(1 / (1 + exp(-(0.75::DOUBLE * greatest(0, 0.5::DOUBLE * x + 0.25::DOUBLE * y - 0.5::DOUBLE * w + g + 0.1::DOUBLE) - 0.5::DOUBLE * greatest(0, -0.25::DOUBLE * x + 0.5::DOUBLE * y + 0.25::DOUBLE * w + p + 0.2::DOUBLE) + 0.05::DOUBLE))), 4) AS score FROM v""",
    "noted_events": f"{O._sql(O.EVENTS)} SELECT event_id, CASE WHEN number % 6 = 0 THEN 'seen ' || event_id ELSE note END AS note FROM e",
    "logged_actions": f"""{O._sql(O.LOGS)}, b AS (SELECT * FROM l WHERE id % 5 > 0), d AS (SELECT username || 'x' AS username, role, 'redo ' || CAST(id AS VARCHAR) AS action, created_at FROM l WHERE id % 3 = 0)
        SELECT id, username, role, action FROM b UNION ALL SELECT (SELECT max(id) FROM b) + row_number() OVER (ORDER BY CAST(created_at AS DATE), created_at, username, action), username, role, action FROM d""",
    "cached_regions": """WITH c AS (SELECT c_custkey AS k, '1.1.1.' || CAST(c_custkey AS VARCHAR) AS ip, c_mktsegment AS seg FROM customer)
        SELECT ip, CASE WHEN k % 4 > 0 AND k % 5 > 0 THEN 'new ' || seg WHEN k % 4 > 0 AND NOT k % 6 = 0 THEN '未知' ELSE seg END AS region,
        CASE WHEN k % 4 > 0 AND k % 5 > 0 THEN 'remote' WHEN k % 4 > 0 AND NOT k % 6 = 0 THEN 'fallback' WHEN k % 2 = 0 THEN 'remote' ELSE 'fallback' END AS source FROM c WHERE k % 3 = 0 OR k % 4 > 0""",
    "replaced_documents": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id * 2 FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT doc_id * 2, 'xx', source FROM documents WHERE doc_id % 3 = 0",
    "replaced_config": "SELECT r_name AS config_key, CASE WHEN r_name = 'ASIA' THEN 'new' ELSE 'stored' END AS config_value FROM region UNION ALL SELECT n_name, 'new' FROM nation WHERE n_nationkey >= 2",
    "exported_cases_updated": """SELECT 'batch-' || CAST(user_id % 50 AS VARCHAR) AS file_id, event_id AS seq_id, event_id + 1 AS case_no, CASE WHEN round(value, 1) >= 60 THEN round(value, 1) ELSE 0.25 END::DOUBLE AS raw_score, 'done' AS status FROM events
        WHERE round(value, 1) >= 50 AND event_id % 3 = 0""",
    "chosen_attacks": f"""{O._sql(O.EVENTS)}, z AS (SELECT CASE WHEN number % 3 = 0 THEN 'xss' WHEN number % 5 = 0 THEN 'nmap' ELSE attack_type END AS kind FROM e) SELECT {O.label('kind')} AS attack_type, count(*) AS total FROM z GROUP BY 1""",
    "joined_regions": """WITH p AS (SELECT n_nationkey, n_nationkey % 4 < 2 AS home, list_filter([CASE WHEN n_nationkey % 4 = 2 THEN n_name END, CASE WHEN n_nationkey % 3 > 0 THEN 'p' || CAST(n_nationkey AS VARCHAR) END,
        CASE WHEN n_nationkey % 5 > 1 THEN 'c' || CAST(n_nationkey AS VARCHAR) END], lambda x: x IS NOT NULL) AS parts FROM nation) SELECT n_nationkey, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '/') WHEN home THEN '中国' ELSE '未知' END AS region FROM p""",
    "region_labels": "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '美国' WHEN 2 THEN '北京' WHEN 3 THEN '内网' ELSE '未知' END AS region FROM supplier",
    "assigned_machines": f"{O._sql(O.EVENTS)} SELECT CAST('0x' || substr(md5(event_id), 1, 8) AS BIGINT) % 8 + 1 AS machine, count(*) AS total FROM e GROUP BY 1",
    "joined_confusion": f"""WITH s AS (SELECT value / 100 >= 0.46 AS hit, event_type IN ('error', 'click') AS bad FROM events WHERE event_id % 4 > 0 AND event_id % 3 > 0),
        c AS (SELECT 0 AS threshold, count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp, count(*) FILTER (NOT hit AND NOT bad) AS tn, count(*) FILTER (NOT hit AND bad) AS fn FROM s), k AS (SELECT {O.METRIC_COLUMNS} FROM c)
        SELECT * EXCLUDE (threshold), CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, recall + tnr - 1 AS youden_j FROM k""",
    "traced_scores": f"{O._sql(O.REQUESTS)} SELECT seq_id, {_TRACE} AS trace, CASE WHEN seq_id % 4 = 0 THEN 1 ELSE 0 END AS is_attack, seq_id % 100 / 100.0::DOUBLE AS score FROM r WHERE seq_id % 5 > 0 AND seq_id % 6 = 0",
    "event_search_custom": f"{O._sql(O.EVENTS)} SELECT risk_level, count(*) AS total FROM e WHERE occurred_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' GROUP BY 1",
    "fallback_search": "SELECT doc_id, 0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'licens') ORDER BY doc_id LIMIT 5",
    "document_total": f"WITH d AS (SELECT {O._FOLD} AS t FROM documents WHERE source = 'src0') SELECT count(*) AS total FROM d WHERE contains(t, ' license ') OR contains(t, ' re  mit ')",
    "knowledge_context": f"""WITH h AS ({_BEST}), j AS (SELECT row_number() OVER (ORDER BY score, doc_id) AS i, d.* FROM h JOIN documents d USING (doc_id))
        SELECT left(string_agg('[RAG#' || CAST(i AS VARCHAR) || '] title=' || source || ' attack_type=' || lang || ' severity=high evidence=' || CAST(n_chars AS VARCHAR) || ' mitigation=', chr(10) ORDER BY i), 300) AS context FROM j""",
    "decoded_payloads": "SELECT doc_id, md5(coalesce(text, '')) AS decoded FROM documents",
    "captured_payloads": "SELECT doc_id, md5(coalesce('q=' || text, '')) AS decoded FROM documents",
    "decoded_blocks": "SELECT doc_id, md5('POST /x' || CASE WHEN doc_id % 3 > 0 THEN chr(10) || 'Body:' || chr(10) || text ELSE ' ' || hex(encode(text)) END) AS decoded FROM documents",
    "normalised_texts": "SELECT doc_id, md5('METHOD=GET' || chr(10) || 'REQUEST_BODY=' || text || chr(10) || 'END') AS decoded FROM documents",
    "value_lines": f"""WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(text, '(?m)^(\\S+) ', 'String value: \\1 ', 'g'), chr(10)), lambda x: contains(x, 'String value:')), lambda x: regexp_replace(x, {_STRIP})) AS v FROM documents)
        SELECT doc_id, md5(array_to_string(v[1:20], ' | ')) AS lines, md5(array_to_string(v[1:2], ' | ')) AS two FROM l""",
    "cleaned_texts": f"{O._sql(O.REQUESTS)} SELECT seq_id, regexp_replace('a ' || replace(uri, '/', ' ') || ' ', {_STRIP}) AS cleaned, 'STATUS_CODE=' || CAST(status_code AS VARCHAR) || chr(10) || 'RESPONSE_EXCERPT=x' AS response_text FROM r",
    "verbose_messages": f"""{O._sql(O.REQUESTS)} SELECT CAST(seq_id AS VARCHAR) AS file_id, 2 * seq_id AS frame_no, 12.5::DOUBLE AS time, method, regexp_replace(uri, '\\s', '+', 'g') AS uri, CASE WHEN host = '' THEN 'User-Agent: ' || user_agent ELSE host END AS host, user_agent,
        'String value: q1' AS request_body, NULL AS status_code, NULL AS response_excerpt, 2 * seq_id + 1 AS response_frame, NULL AS request_frame, '1.2.3.4' AS src_ip, 4000 AS src_port, 80 AS dst_port FROM r
        UNION ALL SELECT CAST(seq_id AS VARCHAR), 2 * seq_id + 1, NULL, NULL, NULL, NULL, NULL, NULL, status_code, 'Number value: 406 | True value', NULL, 2 * seq_id, NULL, NULL, NULL FROM r""",
    "packet_lines": """WITH n AS (SELECT conv_id * 1000 + turn AS n, conv_id FROM conversations) SELECT CAST(n AS VARCHAR) AS frame_number, CAST(conv_id AS VARCHAR) AS stream, CASE n % 3 WHEN 0 THEN '/a "b" c' WHEN 1 THEN '/a"b' ELSE '/plain' END AS uri,
        CASE WHEN n % 2 = 0 THEN 'h' END AS host, CASE WHEN n % 2 = 0 THEN '7' END AS response_in FROM n""",
    "json_round_trip": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS note FROM orders",
    "csv_round_trip": "SELECT doc_id, md5('\"q\", ' || text) AS line, source FROM documents",
    "manifest_rows": """SELECT 'b.' || CAST(event_id AS VARCHAR) AS case_id, 'f' || CAST(user_id % 9 AS VARCHAR) AS file_id, CAST(event_id AS INTEGER) AS seq_id, round(value, 1) AS raw_score, 'pending' AS status, CAST(round(value, 1) AS VARCHAR) AS written,
        '' AS raw_response_block FROM events""",
    "enriched_cases": f"{O._sql(O.REQUESTS)} SELECT 'b.' || CAST(seq_id AS VARCHAR) AS case_id, 'b.' || CAST(seq_id AS VARCHAR) || ':' || CAST(length(method) + 1 + length(host) AS VARCHAR) AS analysis FROM r",
    "masked_samples": """SELECT doc_id, md5('{"password": "***"}' || chr(10) || 'Cookie: ***' || chr(10) || 'X: y' || chr(10) || 'authorization: ***') AS masked FROM documents WHERE length(text) > 0""",
    "masked_documents": f"SELECT doc_id, sha256({_MASKED}) AS masked_sha256 FROM documents",
    "paired_in_order": f"WITH {_PAIRS} SELECT stream, turn, request_place, response_place FROM f WHERE request_place IS NOT NULL AND response_place IS NOT NULL",
    "stream_paired_packets": f"WITH {_PAIRS} SELECT stream, request_place, response_place FROM f WHERE request_place IS NOT NULL AND response_place IS NOT NULL",
    "stream_counted_batches": """WITH n AS (SELECT user_id % 16 AS shard, event_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) - 1 AS spot, count(*) OVER (PARTITION BY user_id % 16) AS n FROM events)
        SELECT shard, event_id, spot // 20 AS batch FROM n WHERE spot // 20 < n // 20""",
    "stream_admitted": O.ORACLE["admitted_requests"],
    "accented_bm25": O.bm25(("fur", "cion", "leger", "re"), 25),
    "indexed_bm25": O.bm25(("the", "license", "re on", "fur"), 20),
    "changed_index_bm25": O.bm25(("license mit", "fur", "the"), 20, _CHANGED),
    "indexed_search": f"""WITH d AS (SELECT doc_id, source, {O._FOLD} AS t FROM documents)
        SELECT doc_id, source FROM d WHERE contains(t, ' license ') OR contains(t, ' fur ') ORDER BY doc_id DESC LIMIT 20 OFFSET 20""",
    "changed_index_total": f"WITH d AS (SELECT {O._FOLD} AS t FROM {_CHANGED} WHERE source = 'src0') SELECT count(*) AS total FROM d WHERE contains(t, ' license ') OR contains(t, ' re  mit ')",
    "event_pages": f"""WITH {O.EVENTS} SELECT event_id, occurred_at, source_ip FROM e WHERE occurred_at BETWEEN {O.AS_OF} - INTERVAL 30 DAY AND {O.AS_OF} AND risk_level = 'high'
        ORDER BY occurred_at DESC, event_id LIMIT 50 OFFSET 100""",
    "stream_paired_across": f"""WITH {_PAIRS}, q AS (SELECT conv_id AS stream, turn AS place FROM conversations WHERE role = 'user'), a AS (SELECT conv_id AS stream, turn AS place FROM conversations WHERE role = 'assistant')
        SELECT stream, stream * 1048576 + request_place AS request, stream * 1048576 + response_place AS response FROM f WHERE stream % 4 >= 2 AND request_place IS NOT NULL AND response_place IS NOT NULL
        UNION ALL SELECT a.stream, q.stream * 1048576 + q.place, a.stream * 1048576 + a.place FROM a JOIN q ON q.stream = xor(a.stream, 1) AND q.place = a.place - 1 WHERE a.stream % 4 < 2""",
    "stream_attempts": f"""WITH p AS (SELECT 'f' || CAST(user_id % 200 AS VARCHAR) AS file_id,
          list({{'at': ts, 'ok': value >= 150, 'error': event_type || CAST(event_id AS VARCHAR), 'n': 0::INTEGER, 'state': 'failed'}} ORDER BY ts, event_type || CAST(event_id AS VARCHAR)) AS polls FROM events GROUP BY 1),
        r AS (SELECT file_id, list_reduce(polls, lambda a, x: CASE WHEN a.state IN ('done', 'ignored') OR (a.at IS NOT NULL AND epoch(x.at) - epoch(a.at) < {_REST}) THEN a
          WHEN x.ok THEN {{'at': NULL::TIMESTAMP, 'ok': true, 'error': NULL::VARCHAR, 'n': 0::INTEGER, 'state': 'done'}}
          ELSE {{'at': x.at, 'ok': false, 'error': x.error, 'n': (a.n + 1)::INTEGER, 'state': CASE WHEN a.n + 1 >= 20 THEN 'ignored' ELSE 'failed' END}} END, {_START}) AS t FROM p)
        SELECT file_id, t.n AS attempts, t.state AS state, strftime(t.at, '%Y-%m-%d %H:%M:%S') AS failed_at, t.error AS error,
          t.state NOT IN ('done', 'ignored') AND (t.at IS NULL OR epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(t.at) >= {_REST}) AS due FROM r""",
    "case_passes": _passes(),
    "retried_errors": """WITH k AS (SELECT list_extract(['Connection refused by 10.0.0.1', 'read TIMED OUT', 'WinError 10061', 'no JSON in the answer', 'HTTP 500', 'llama runner process has terminated: x', 'Internal Server Error'],
          CAST(o_orderkey % 7 + 1 AS BIGINT)) AS error FROM orders) SELECT error, error <> 'no JSON in the answer' AS retried, count(*) AS total FROM k GROUP BY error""",
}
