"""Readers and writers of files, streams over many files and restarts, and case functions on small tables."""

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palisade import case_queries
from palisade.functions import features
from palisade.operators import cases
from palisade.plans import events, retrieval
from palisade.sources import canonical, case_folders, files
from palisade.streaming import jobs


def put(folder, name, tables, first=0):
    """Part files of a table, with rising modification times."""
    (folder / f"{name}.parquet").mkdir(exist_ok=True)
    for i, t in enumerate(tables, start=first):
        path = folder / f"{name}.parquet" / f"part-{i:03d}.parquet"
        pq.write_table(pa.table(t), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_texts_in_several_encodings(spark, tmp_path):
    for name, data in (("a.txt", "häß".encode()), ("b.txt", b"\xef\xbb\xbfmark"), ("c.txt", "中文".encode("gbk")), ("d.txt", b"\xff\xfe\xfa caf\xe9")):
        (tmp_path / name).write_bytes(data)
    got = {r.file_id: r.value for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "häß", "b": "mark", "c": "中文", "d": "ÿþú café"}


def test_json_and_csv_files(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"k": 1, "v": "x"}\nnot json\n{"k": 2}\n')
    assert sorted(map(tuple, files.json_lines(spark, str(tmp_path / "lines.jsonl"), "k long, v string", tolerant=True).collect())) == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, str(tmp_path / "lines.jsonl"), "k long, v string").collect()
    (tmp_path / "seed.json").write_text(json.dumps([{"doc_id": "X", "title": "t", "severity": " "}, {"content": "c", "source": "s"}]))
    got = [(r.doc_id, r.title, r.content, r.severity, r.source) for r in files.knowledge(spark, str(tmp_path / "seed.json"), "RAG").collect()]
    assert got == [("X", "t", "", "medium", "local_seed"), ("RAG-0002", "", "c", "medium", "s")]


def test_case_folders_and_order_of_files(spark, tmp_path):
    for name in ("b.2", "b.10", "b.x"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "case.json").write_text(f"{{'{name}'}}\nend")
    rows = files.case_files(spark, f"{tmp_path}/*/case.json").orderBy("number").collect()
    assert [(r.case_id, r.number) for r in rows] == [("b.2", 2), ("b.10", 10), ("b.x", 10**9)] and rows[0].value == "{'b.2'}\nend"
    names = spark.createDataFrame([("1.1.2",), ("1.1.10",), ("odd",)], "file_id string")
    assert [r.file_id for r in files.in_order(names).collect()] == ["1.1.2", "1.1.10", "odd"]
    assert [r.file_id for r in files.in_order(names.where("file_id <> 'odd'"), newest_first=True).collect()] == ["1.1.10", "1.1.2"]


def test_lines_of_a_case_are_split_once(spark):
    rows = spark.createDataFrame([("\n".join([f"k{i % 200} = {i}" for i in range(300)] + ["no pair", "=x"]),)], "t string").select(canonical.key_values(F.col("t")).alias("m"))
    assert rows.first().m == {f"k{i}": str(i + 200 if i < 100 else i) for i in range(200)}
    assert rows._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_case_folders_written_and_read_from_their_root(spark, tmp_path):
    root = f"{tmp_path}/result"
    rows = [("b.2", "two\n"), ("b.10", "é"), ("b.2", "two\n"), ("b.2", "other"), ("b.x7", ""), ("b.8", None)]
    case_folders.write_case_files(spark.createDataFrame(rows, "case_id string, value string"), f"file://{root}")
    assert sorted(os.listdir(root)) == ["b.10", "b.2", "b.8", "b.x7"] and sorted(os.listdir(f"{root}/b.2")) == ["case-1.txt", "case-2.txt", "case-3.txt"]
    os.mkdir(f"{root}/logs")
    (tmp_path / "result" / "logs" / "log.txt").write_text("no case")
    assert sorted((r.case_id, r.value) for r in files.case_files(spark, root).collect()) == sorted((c, f"{v or ''}\n") for c, v in rows)
    with pytest.raises(Exception, match="no name of a case"):
        case_folders.write_case_files(spark.createDataFrame([("../b.1", "")], "case_id string, value string"), root)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', None), (2, " b ", "ü")], "k int, z string, a string")
    files.write_csv(df.coalesce(1), f"{tmp_path}/c", sort_columns=True, marked=True)
    text = next((tmp_path / "c").glob("part-*")).read_bytes().decode("utf-8-sig")
    assert text == 'a,k,z\n,1,"a ""q"""\nü,2, b \n'
    files.write_csv(df.where("false"), f"{tmp_path}/e", sort_columns=True)
    assert "".join(p.read_text() for p in (tmp_path / "e").glob("part-*")).strip().strip('"') == "empty"
    files.write_json_lines(df, f"{tmp_path}/j")
    files.write_json_lines(df, f"{tmp_path}/j", append=True)
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 4 and {"k": 1, "z": 'a "q"', "a": None} in lines and "ü" in next(x["a"] for x in lines if x["k"] == 2)
    files.write_report(spark.createDataFrame([("2024-01-02", 3), ("2024-01-01", 2)], "day string, attack_total long"), f"{tmp_path}/r")
    assert next((tmp_path / "r").glob("part-*")).read_text().split() == ["day,attack_total", "2024-01-01,2", "2024-01-02,3"]
    seen, count = files.counted(df, "stage-one")
    assert seen.where("k > 0").count() == 2 and count.get["rows"] == 2


def plain_pairs(rows):
    """Responses answer the waiting request that they name, else the one that waits longest."""
    waiting, out = [], []
    for place, is_request, name in rows:
        if is_request:
            waiting.append(place)
        elif waiting:
            answered = name if name in waiting else waiting[0]
            waiting.remove(answered)
            out.append((answered, place))
    return sorted(out)


def test_streams_pair_by_name_and_in_order_over_restarts(spark, tmp_path):
    rng = np.random.default_rng(9)
    roles = ["user" if x else "assistant" for x in rng.integers(0, 2, 60)]
    tables = [{"conv_id": [5] * 10, "turn": list(range(a, a + 10)), "role": roles[a : a + 10]} for a in range(0, 60, 10)]
    place = jobs.folder(spark)

    def run(count):
        folder = put(tmp_path, "conversations", tables[:count])
        t = jobs.source(spark, folder, "conversations", files=2)
        names = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.col("turn") - 2).cast("long")
        packets = t.select(F.col("conv_id").alias("stream"), F.col("turn").alias("place"), (F.col("role") == "user").alias("is_request"), names.alias("request_place"))
        return sorted((r.request_place, r.response_place) for r in jobs.paired(spark, packets, place).collect())

    for count in (3, 6):
        assert run(count) == plain_pairs([(i, r == "user", i - 2 if i % 3 == 0 else None) for i, r in enumerate(roles[: 10 * count])])


def test_paired_frames_query(spark, small):
    turns = spark.read.parquet(f"{small}/conversations.parquet").where("role IN ('user', 'assistant')").orderBy("conv_id", "turn").collect()
    want = []
    for c in {t.conv_id for t in turns}:
        want += [(c, *p) for p in plain_pairs([(t.turn, t.role == "user", t.turn - 2 if t.turn % 3 == 0 else None) for t in turns if t.conv_id == c])]
    assert sorted(map(tuple, case_queries.stream_paired_frames(spark, small).collect())) == sorted(want)


def test_hourly_counts_go_on_after_a_restart(spark, tmp_path):
    files_ = [{"ts": [f"2024-01-0{i + 1} 01:10:00"] * 3, "event_type": ["a"] * 3, "value": [90.0, 1.0, 2.0]} for i in range(4)]
    place = jobs.folder(spark)
    for count in (2, 4):
        folder = put(tmp_path, "events", files_[:count])
        got = {r.hour: r.total for r in jobs.hourly_counts(spark, folder, place).collect()}
        assert got == {f"2024-01-0{i + 1} 01:00:00": 3 for i in range(count)}


def test_keyed_table_over_many_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    place, rows = jobs.folder(spark), []
    tables = [{"user_id": rng.integers(0, 200, 50), "event_id": rng.permutation(10_000)[:50] + 20_000 * (i % 2), "event_type": [f"t{i}"] * 50} for i in range(20)]
    for count in (10, 20):
        folder = put(tmp_path, "events", tables[:count])
        got = {r.user_id: (r.event_id, r.event_type) for r in jobs.latest_by_user(spark, folder, place).collect()}
        rows = [(int(u), (int(e), t)) for x in tables[:count] for u, e, t in zip(x["user_id"], x["event_id"], x["event_type"], strict=True)]
        assert {u: e[0] for u, e in got.items()} == {u: max(e for v, (e, _) in rows if v == u) for u, _ in rows}


def test_batches_leave_when_full_and_the_rest_waits(spark, tmp_path):
    rng = np.random.default_rng(2)
    tables = [{"shard": rng.integers(0, 3, 23), "n": list(range(100 * i, 100 * i + 23))} for i in range(7)]
    place = jobs.folder(spark)
    for count in (4, 7):
        stream = jobs.source(spark, put(tmp_path, "packets", tables[:count]), "packets", files=1)
        got = sorted((r.shard, r.batch, r.n) for r in jobs.counted_batches(stream, place, 5, "shard", "n").collect())
        want = []
        for s in range(3):
            mine = [n for t in tables[:count] for k, n in zip(t["shard"], t["n"], strict=True) if k == s]
            want += [(s, i // 5, n) for i, n in enumerate(mine) if i // 5 < len(mine) // 5]
        assert got == sorted(want)


def test_features_by_name_and_categories(spark):
    known = {"sbytes": "1", "spkts": "2", "sload": "3", "sttl": "4", "smean": "5", "sjit": "6", "own_pkt": "7"}
    assert [features.named(c, known, "8") for c in ("own_pkt", "a_PKT", "ct_ttl", "ct_x", "is_x", "xbytes", "z", "djitter")] == ["7", "2", "4", "8", "0D", "1", "0D", "6"]
    row = spark.range(1).select(*[features.category(c, k, F.lit(e)).alias(f"x{i}") for i, (c, k, e) in enumerate([("state", ["FIN", "INT"], True), ("state", ["FIN", "INT"], False), ("proto", ["gre", "udp"], True), ("proto", [], True), ("odd", ["q"], False), ("odd", [], False)])]).first()
    assert list(row) == ["INT", "FIN", "udp", "tcp", "q", "unknown"]


def test_canonical_records_fill_in_what_is_missing(spark):
    text = "### BATCH_START ###\n### CASE_START ###\nseq_id=x\nframe_resp=9\nmethod=GET\nstatus_code=404\nrequest_text=A=1\\nREQUEST_BODY=68656c6c6f\\\n[REQUEST_BLOCK]\nGET /\nBody:\n68656c6c6f\n[/REQUEST_BLOCK]\n[RESPONSE_BLOCK]\nHTTP\n[/RESPONSE_BLOCK]\n### CASE_END ###\n### CASE_START ###\nfile_id=own\nseq_id=7\ntime_req=1.5\nstatus_code=200\n### CASE_END ###"
    one, two = canonical.parsed(spark.createDataFrame([("f", text)], "file_id string, value string")).orderBy("place").collect()
    assert (one.file_id, one.seq_id, one.frame_req, one.frame_resp, one.time_req, one.time_resp, one.status_code, one.src_port) == ("f", 1, 1, 9, 1.0, 1.01, 404, 0)
    assert (one.request_text, one.request_body, one.request_block, one.response_block) == ("A=1\nREQUEST_BODY=hello", "hello", "GET /\nBody:\nhello", "HTTP")
    assert (two.file_id, two.seq_id, two.frame_req, two.time_req, two.frame_resp, two.time_resp, two.status_code, two.response_block) == ("own", 7, 7, 1.5, None, None, None, None)


def test_summary_lines_split_verbose_prints(spark):
    text = "  1 0.5 host-a 5.6.7.8 HTTP 99 GET /a\nGET /a HTTP/1.1\nHost: h:443\nFile Data: 3 bytes\n abc\n  2 0.7 5.6.7.8 host-a HTTP 99 OK\nHTTP/1.1 200 OK\nFile Data: 2 bytes\nhi"
    found = canonical.messages(canonical.blocks(spark.createDataFrame([("f", text)], "file_id string, value string"))).orderBy("block_no").collect()
    assert [(r.frame_no, r.time, r.src_ip, r.method, r.full_uri, r.request_body, r.status_code, r.response_excerpt) for r in found] == [
        (1, 0.5, "host-a", "GET", "https://h:443/a", "abc", None, None), (2, 0.7, "5.6.7.8", None, None, None, 200, "hi")]


def test_case_look_up_asks_for_a_key(spark):
    rows = spark.createDataFrame([("b.1", "f", 1)], "case_id string, file_id string, seq_id long")
    assert events.case_rows(rows, file_id="f", seq_id="1").count() == events.case_rows(rows, case_id=" b.1 ").count() == 1
    for wrong in ({}, {"file_id": "f"}, {"file_id": "f", "seq_id": "x"}):
        with pytest.raises(ValueError):
            events.case_rows(rows, **wrong)


def test_numbering_in_two_steps_is_one_order(spark):
    rows = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("k"))
    got = cases.numbered(rows, F.col("k")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 501)) and [r.k for r in got] == sorted(r.k for r in got)


def test_search_terms_are_phrases(spark):
    docs = spark.createDataFrame([(1, "The Re-use of it", "a"), (2, "reuse", "a"), (3, "x / y", "b")], "doc_id long, text string, source string")
    of = lambda text, attack=None: [r.doc_id for r in retrieval.search(docs, text, attack).collect()]
    assert of("re-use") == [1] and of("REUSE it") == [2, 1] and of("/") == [3] and of("") == [3, 2, 1] and of("", "a") == [2, 1]
    assert retrieval.total(docs, "reuse it", "a").first().total == 2
