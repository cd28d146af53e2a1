"""Column functions, parsers and operators on small tables of cases."""

import math
import os
import re
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palisade import queries
from palisade.functions import addresses, http, labels, payloads, scoring
from palisade.operators import mutations, pairing, ranking
from palisade.plans import evaluation, events, retrieval
from palisade.sources import canonical
from palisade.streaming import jobs


def values(spark, inputs, expression, kind="string"):
    """``expression`` of each input, in order."""
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_attack_labels(spark):
    raw = ["sqli", "Cross XSS", "brute force", "port-scan", "resource", "", None, "nmap", "Command_Injection", "文件上传", "other"]
    want = ["SQL注入", "XSS", "RCE", "端口扫描", "RCE", labels.OTHER, labels.OTHER, "端口扫描", "命令注入", "文件上传", labels.OTHER]
    assert values(spark, raw, labels.attack_label) == want
    assert values(spark, ["brute force"], lambda c: labels.attack_label(c, strict=True)) == ["暴力破解"]
    names = [t[0] for t in labels.ATTACK_TESTS]
    assert values(spark, names, labels.attack_label) == names


def test_inferred_attacks(spark):
    texts = ["/a?id=1 OR 1=1", "<SCRIPT>", "../../etc/passwd", "; cat /x", "x.php", "masscan", "hello", "id=1' or '1"]
    want = ["SQL注入", "XSS", "路径遍历", "命令注入", "文件上传", "端口扫描", labels.OTHER, "SQL注入"]
    assert values(spark, texts, labels.inferred_attack) == want


def test_addresses(spark):
    ips = ["8.8.8.8", "10.1.2.3", "100.64.0.1", "172.32.0.1", "192.0.2.9", "224.0.0.1", "08.8.8.8", "256.1.1.1", "x", None, " 1.1.1.1 "]
    assert values(spark, ips, addresses.is_public) == [True, False, False, True, False, True, False, False, False, False, True]
    assert values(spark, ips, addresses.canonical_address)[-1] == "1.1.1.1"


def test_risk_and_result(spark):
    assert values(spark, [200, 403, 500, 418, None], labels.attack_result, "int") == ["success", "blocked", "blocked", "success", "success"]
    risk = lambda c: labels.risk(F.lit(None).cast("string"), c, F.lit(0.9), F.lit("suspicious"))
    assert values(spark, [0.8, 0.5, 0.1, None], risk, "double") == ["high", "medium", "medium", "high"]


def test_request_functions(spark):
    uris = ["/a/b/c.js?v=1", "/a.jsp", None, "/x/y?q=1?z"]
    assert values(spark, uris, http.is_static) == [True, False, False, False]
    assert values(spark, ["/a/b/c.js?v=1", "/a.jsp", "//x/?y/z", ""], http.path_depth) == [3, 1, 1, 0]
    assert values(spark, ["/x?q=1?z", "/x"], http.query_length) == [5, 0]
    assert values(spark, ["' or '--", "aaa"], lambda c: http.counted(c, http.SPECIAL_MARKS)) == [4, 0]
    assert values(spark, ['{"password": "x y"}\nCookie: a=b'], http.masked) == ['{"password": "***"}\nCookie: ***']
    assert values(spark, ["68656c6c6f", "68:65:6c:6c:6f", "abc", "zz" * 4], payloads.unhexed) == ["hello", "hello", "abc", "zz" * 4]
    assert values(spark, ["https://A.b:443/x", "[::1]", "H"], http.host_name) == ["a.b", "::1", "h"]


def test_canonical_texts(spark):
    row = (1, "b1", 7, "GET", "/x", "h", 200, "t/h", "A=1\nB=2", "req", "resp\nmore")
    df = spark.createDataFrame([row], "batch int, file_id string, seq_id long, method string, uri string, host string, status_code int, content_type string, request_text string, request_block string, response_block string")
    back = canonical.parsed(canonical.batch_texts(df)).collect()
    assert [(r.seq_id, r.method, r.request_text, r.request_block, r.response_block) for r in back] == [(7, "GET", "A=1\nB=2", "req", "resp\nmore")]
    assert values(spark, ["a=1\n\nb = x=y\na=2\nno"], canonical.key_values) == [{"a": "2", "b": "x=y"}]


def test_verbose_prints(spark):
    text = "Frame 1: x\nSrc: 1.2.3.4, Dst: 5.6.7.8\nGET /a HTTP/1.1\nHost: h.x\nUser-Agent: u\n[Response in frame: 2]\nFrame 2: y\nHTTP/1.1 404 Not Found\n[Request in frame: 1]\n"
    found = canonical.messages(canonical.blocks(spark.createDataFrame([("f", text)], "file_id string, value string"))).orderBy("block_no").collect()
    assert [(r.frame_no, r.method, r.uri, r.full_uri, r.status_code, r.response_frame, r.request_frame, r.src_ip) for r in found] == [
        (1, "GET", "/a", "http://h.x/a", None, 2, None, "1.2.3.4"), (2, None, None, None, 404, None, 1, None)]


def fifo(rows):
    waiting, out = [], []
    for place, request in sorted(rows):
        if request:
            waiting.append(place)
        elif waiting:
            out.append((waiting.pop(0), place))
    return out


def test_pairing_is_first_in_first_out(spark):
    rng = np.random.default_rng(4)
    rows = [(s, p, bool(rng.integers(0, 2))) for s in range(12) for p in range(15)]
    got = pairing.in_order(spark.createDataFrame(rows, "stream long, place long, is_request boolean")).collect()
    for s in range(12):
        assert sorted((r.request_place, r.response_place) for r in got if r.stream == s) == fifo([(p, q) for x, p, q in rows if x == s])


def test_stream_pairs_like_the_batch(spark, small):
    from palisade import queries

    batch = {(r.stream, r.request_place, r.response_place) for r in queries.paired_in_order(spark, small).collect()}
    assert {tuple(r) for r in jobs.paired_packets(spark, small).collect()} == batch


def many_files(folder, name, tables):
    """A table in part files with rising modification times."""
    (folder / f"{name}.parquet").mkdir()
    for i, t in enumerate(tables):
        path = folder / f"{name}.parquet" / f"part-{i:03d}.parquet"
        pq.write_table(pa.table(t), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_hourly_counts_of_many_files_lose_no_event(spark, tmp_path):
    # each later file has older events
    files = [{"ts": [f"2024-01-{20 - i:02d} 0{h}:10:00" for h in (1, 1, 2)] + ["2024-01-15 05:00:00"], "event_type": ["a", "a", "b", "a"], "value": [90.0, 1.0, 2.0, 80.0]} for i in range(20)]
    got = {(r.hour, r.event_type): (r.total, r.high) for r in jobs.hourly_counts(spark, many_files(tmp_path, "events", files)).collect()}
    want = {("2024-01-15 05:00:00", "a"): (20, 20)}
    for i in range(20):
        want |= {(f"2024-01-{20 - i:02d} 01:00:00", "a"): (2, 1), (f"2024-01-{20 - i:02d} 02:00:00", "b"): (1, 0)}
    assert got == want


def test_stream_keeps_all_pending_requests(spark, tmp_path):
    turns = [(i, "user") for i in range(3000)] + [(i, "assistant") for i in range(3000, 5500)]
    files = [{"conv_id": [7] * 250, "turn": [i for i, _ in turns[a : a + 250]], "role": [r for _, r in turns[a : a + 250]]} for a in range(0, 5500, 250)]
    folder = many_files(tmp_path, "conversations", files)
    packets = spark.read.parquet(f"{folder}/conversations.parquet").select(F.col("conv_id").alias("stream"), F.col("turn").alias("place"), (F.col("role") == "user").alias("is_request"))
    want = sorted((r.stream, r.request_place, r.response_place) for r in pairing.in_order(packets).collect())
    assert len(want) == 2500 and sorted(map(tuple, jobs.paired_packets(spark, folder).collect())) == want


def test_flow_features_and_canonical_texts_hold_whole_pages(spark, tmp_path):
    html = "x" * 600 + " password\nend"
    folder = many_files(tmp_path, "pages", [{"page_id": [1, 51, 101, 151], "url": ["http://a.b/c"] * 4, "html": [html] * 4}])
    row = queries.flow_features(spark, folder).where("seq_id = 1").first()
    assert row.ct_src_ltm == 2 and row.sbytes == 100 + len("/c") + len(html) + len("agent/1") + 30 * 2
    assert canonical.parsed(queries.canonical_texts(spark, folder)).first().response_block == html


def test_upsert_is_idempotent_and_keeps_columns(spark):
    base = spark.createDataFrame([(1, "a", "mine"), (2, "b", None)], "k int, v string, note string")
    delta = spark.createDataFrame([(2, None, "new"), (3, "c", "new")], "k int, v string, note string")
    once = mutations.upsert(base, delta, ["k"], keep=("note",))
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "a", "mine"), (2, None, None), (3, "c", "new")]
    assert sorted(map(tuple, mutations.upsert(once, delta, ["k"], keep=("note",)).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    with pytest.raises(ValueError):
        mutations.set_status(base, F.lit(True), "open")


def test_rank_is_a_permutation_and_scale_is_bounded(spark):
    rows = [("f", i, s) for i, s in enumerate([0.5, 0.9, 0.5, None, 0.1])] + [("g", 1, 0.3), ("g", 2, 0.3)]
    got = ranking.rerank(spark.createDataFrame(rows, "file_id string, seq_id long, score double")).collect()
    assert sorted(r["rank"] for r in got if r.file_id == "f") == [1, 2, 3, 4, 5]
    assert [r.seq_id for r in sorted(got, key=lambda r: r["rank"]) if r.file_id == "f"] == [1, 0, 2, 4, 3]
    assert all(0 <= r.norm_score <= 1 for r in got) and all(r.norm_score == 0 for r in got if r.file_id == "g")


def test_sweep_equals_counting_each_threshold(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), int(y)) for x, y in zip(np.append(rng.random(300), np.arange(0, 101) / 100.0), rng.integers(0, 2, 401), strict=True)]
    got = {round(r.threshold * 100): (r.tp, r.fp, r.tn, r.fn) for r in evaluation.sweep(spark.createDataFrame(rows, "score double, is_attack int")).collect()}
    for i in range(5, 96):
        t = i / 100.0
        want = [sum(1 for s, y in rows if (s >= t) == a and y == b) for a, b in ((True, 1), (True, 0), (False, 0), (False, 1))]
        assert got[i] == tuple(want)


def test_time_ranges():
    assert events.time_range("1h", "2024-01-02 03:00:00") == ("2024-01-02 02:00:00", "2024-01-02 03:00:00")
    assert events.time_range("odd", "2024-01-02 03:00:00")[0] == "2024-01-01 03:00:00"
    assert events.time_range("custom", start="2024-01-01T00:00:00Z", end="2024-01-02T00:00:00+08:00")[1] == "2024-01-02 00:00:00"
    with pytest.raises(ValueError):
        events.time_range("custom", start="2024-01-02", end="2024-01-01")


def test_fallback_only_without_hits(spark):
    docs = spark.createDataFrame([("a", "xlogin page"), ("b", "other word")], "doc_id string, text string")
    assert [r.doc_id for r in retrieval.with_fallback(docs, ["word"], ["text"]).collect()] == ["b"]
    assert [tuple(r) for r in retrieval.with_fallback(docs, ["login"], ["text"]).collect()] == [("a", 0.0)]


def test_bm25_of_one_term(spark):
    texts = ["a b", "a a c", "d", "e f g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, ["c"], ["text"]).collect()}
    mean = sum(len(t.split()) for t in texts) / 4
    want = -math.log((4 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / mean))
    assert got == {1: pytest.approx(want)}


def test_perceptron(spark):
    rng = np.random.default_rng(2)
    layers = [(rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 1)), rng.normal(size=1))]
    df = spark.createDataFrame([(1.0, "x"), (3.0, "y")], "n double, c string")
    v = scoring.vector(["n"], scoring.scaling(df, ["n"]), {"c": ["x", "z"]})
    got = [r[0] for r in df.select(scoring.perceptron(v, layers)).collect()]
    x = np.array([[-1.0, 1, 0], [1.0, 0, 0]])
    h = np.maximum(x @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1]
    assert got == pytest.approx((1 / (1 + np.exp(-h[:, 0]))).round(6).tolist())


def test_case_and_retry_states(spark):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    assert values(spark, [0, 5, 1], lambda c: jobs.retry_state(c, F.lit("2024-01-01 00:09:50").cast("timestamp"), now), "int") == ["waiting", "ignored", "waiting"]
    assert values(spark, ["pending", "done", "processing"], lambda c: jobs.case_state(c, F.lit("2024-01-01 00:00:00").cast("timestamp"), now)) == ["take", "leave", "take"]
    assert values(spark, ["Read timed out", "bad", None, "HTTP 500", "connection reset", "503"], jobs.can_retry) == [True, False, False, True, False, False]
    no_start = lambda c: jobs.case_state(c, F.lit(None).cast("timestamp"), now)
    assert values(spark, ["processing", "done"], no_start) == ["take", "leave"]
    began = lambda at: lambda c: jobs.case_state(c, F.lit(at).cast("timestamp"), now)
    assert [values(spark, ["processing"], began(f"2024-01-01 00:07:00{part}")) for part in ("", ".5")] == [["take"], ["leave"]]


def plain_capture(value):
    """A captured body, one text at a time."""
    raw = (value or "").strip()
    digits = raw.replace(":", "") if re.fullmatch(r"(?:[0-9A-Fa-f]{2}:)+[0-9A-Fa-f]{2}", raw) else "".join(raw.split()) if re.fullmatch(r"(?:[0-9A-Fa-f]{2}\s+)+[0-9A-Fa-f]{2}", raw) else raw
    if not re.fullmatch(r"(?:[0-9A-Fa-f]{2}){4,}", digits):
        return raw
    text_like = lambda t: t.strip() and payloads._readable(t.strip()) and any(re.search(p.replace(r"\z", r"\Z"), t.strip()) for p in payloads.TEXT_PATTERNS)
    for name in ("utf-8", "latin1"):
        try:
            text = bytes.fromhex(digits).decode(name).strip()
        except UnicodeDecodeError:
            continue
        plain = unquote_plus(text)
        text = plain if ("%" in text or "+" in text) and text_like(plain) else text
        if text_like(text):
            return text
    return raw


def test_payloads(spark):
    texts = ["user=a&b=c", "中文内容 abc", "x%20y=1+2", "100% sure", "plain words", "\x00\x01\x02\x03\x04", "a%zz=b"]
    hexed = [t.encode().hex() for t in texts]
    spaced = [" ".join(h[i : i + 2] for i in range(0, len(h), 2)) for h in hexed]
    odd = [None, "", "  raw ", "abc", "zz" * 4, "ff" * 10, "c4e3bac3cac0bde7".upper(), "中".encode("gb18030").hex() * 4, "41:42:43:44", "0a0d0a0d", "4142 43"]
    inputs = hexed + spaced + odd
    assert values(spark, inputs, payloads.unhexed) == [payloads.plain_unhexed(x or "") for x in inputs]
    assert values(spark, inputs, payloads.captured) == [plain_capture(x) for x in inputs]
    assert values(spark, ["c4e3bac3cac0bde7"], payloads.unhexed) == ["你好世界"]
    assert values(spark, ["61:" * 40_000 + "61"], lambda c: F.length(payloads.unhexed(c))) == [40_001]
    head = "POST /x\nBody:\n"
    assert values(spark, [head + "68656c6c6f", "no body", head], payloads.decoded_block) == [head + "hello", "no body", head]
    stored = r"METHOD=GET\nREQUEST_BODY=68656c6c6f\\nRESPONSE_EXCERPT= 7b7d7b7d \nEND"
    assert values(spark, [stored, r"A=1\nB", None], payloads.normalised_text) == ["METHOD=GET\nREQUEST_BODY=hello\nRESPONSE_EXCERPT={}{}\nEND", "A=1\nB", None]
    block = "x\n  String value: a\r\n False value\nother\nNumber value: 3"
    assert values(spark, [block], payloads.value_lines) == ["String value: a | False value | Number value: 3"]
    assert values(spark, [block], lambda c: payloads.value_lines(c, 1)) == ["String value: a"]


def test_model_input_reads_null_as_empty_and_whole_texts(spark):
    kind = "file_id string, seq_id long, method string, uri string, host string, status_code int, content_type string, user_agent string, body string, response string"
    rows = [("f", 1, "post", None, None, None, None, None, None, None), ("f", 2, "get", "/a?b", "h\\\\n", 404, "x", "u", " {'" + "x" * 900 + "passwd} ", "y" * 600)]
    df = spark.createDataFrame(rows, kind.replace("\\", ""))
    one, two = http.model_input(df).orderBy("seq_id").collect()
    assert (one.method, one.uri_len, one.path_depth, one.is_post, one.resp_is_error, one.user_agent_len) == ("POST", 0, 0, 1, 0, 0)
    assert one.request_text == "METHOD=POST\nURI=\nHOST=\nCONTENT_TYPE=\nSTATUS_CODE=\nREQUEST_BODY=\nRESPONSE_EXCERPT="
    assert (two.has_password_keyword, two.has_json_body, two.resp_is_error, two.special_char_count) == (1, 1, 1, 1)
    assert two.request_text.endswith("RESPONSE_EXCERPT=" + "y" * 500)
    flow = http.flow_features(df.withColumn("time", F.lit(1.0)).withColumn("resp_time", F.lit(2.0))).orderBy("seq_id").collect()
    assert all(v is not None for r in flow for v in r) and flow[0].dpkts == 2 and flow[1].dpkts == 3
