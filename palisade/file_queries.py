"""Registered queries about files, checks of what users give, and runs; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import addresses, checks, http, payloads
from palisade.operators import cases, mutations, ranking
from palisade.plans import dashboard, events, runs
from palisade.sources import canonical, captures, case_folders, files
from palisade.sources import tables as T
from palisade.sources.staging import folder
from palisade.sources.versions import Table
from palisade.streaming import jobs

LABELS = ("SQL注入", "暴力破解", "端口扫描", "路径遍历")


def _label(s: SparkSession, d: str) -> DataFrame:
    """Events with one of four Chinese labels, by their number."""
    n = F.col("event_id")
    return T.stored(s, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, LABELS)), (n % 4 + 1).cast("int")).alias("label"))


def decoded_texts(s: SparkSession, d: str) -> DataFrame:
    """Labels as lines of files of a hundred, half of them in GBK and half in UTF-8 behind a byte-order mark, decoded."""
    rows, packed = _label(s, d), {}
    for name in ("gbk", "utf-8"):
        packed[name] = F.lit(None).cast("string")
        for label in LABELS:
            packed[name] = F.when(F.col("label") == label, F.lit(label.encode(name).hex())).otherwise(packed[name])
    marked = F.floor(F.col("event_id") / 100) % 2 == 0
    lines = rows.select(F.floor(F.col("event_id") / 100).alias("file_id"), marked.alias("marked"), F.when(marked, packed["utf-8"]).otherwise(packed["gbk"]).alias("line"))
    contents = lines.groupBy("file_id", "marked").agg(F.array_join(F.collect_list("line"), "0a").alias("digits"))
    raw = contents.select(F.col("file_id").cast("string").alias("file_id"), F.unhex(F.concat(F.when(F.col("marked"), "efbbbf").otherwise(""), "digits")).alias("content"))
    found = files.decoded(raw).select(F.explode(F.split("value", "\n")).alias("label"))
    return found.groupBy("label").agg(F.count("*").alias("total"))


def json_documents(s: SparkSession, d: str) -> DataFrame:
    """Nations as one JSON array for each region, over several lines, and read again."""
    path = folder(s, "documents")
    of = T.stored(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), {"pretty": "true"}).alias("value"))
    of.select("value").repartition(max(1, of.count())).write.text(path)
    return files.json_documents(s, path, "n_nationkey long, n_name string")


def forgiven_knowledge(s: SparkSession, d: str) -> DataFrame:
    """Knowledge documents from two files, one of which is no JSON."""
    path = folder(s, "seeds")
    one = T.stored(s, d, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.format_string("N-%02d", "n_nationkey").alias("doc_id"), F.col("n_name").alias("title"))))).alias("value"))
    one.coalesce(1).write.text(path)
    one.select(F.concat(F.lit("[{"), "value")).coalesce(1).write.mode("append").text(path)
    return files.knowledge(s, path, forgiving=True).select("doc_id", "title", "severity", "source")


def _case_folders(s: SparkSession, d: str) -> DataFrame:
    path, key = folder(s, "b"), F.col("s_suppkey").cast("string")
    name = F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("b.x"), key)).otherwise(F.concat(F.lit("b."), key))
    case_folders.write_case_files(T.stored(s, d, "supplier").select(name.alias("case_id"), F.concat(F.lit("{\n"), "s_name", F.lit("\n}")).alias("value")), path)
    return files.case_files(s, path)


def case_documents(s: SparkSession, d: str) -> DataFrame:
    """Cases as documents in folders of their own, read again."""
    return _case_folders(s, d).select("case_id", "number", "value")


def newest_cases(s: SparkSession, d: str) -> DataFrame:
    """The cases with the greatest numbers at the end of their names; those without one come first."""
    rows = _case_folders(s, d).select(F.regexp_replace("case_id", "x.*$", "x").alias("file_id"), "value").distinct()
    return files.in_order(rows.groupBy("file_id").agg(F.count("*").alias("total")), newest_first=True).limit(12)


def report_file(s: SparkSession, d: str) -> DataFrame:
    """The daily report as one CSV file, read again."""
    path = folder(s, "report")
    files.write_report(dashboard.daily_report(T.security_events(s, d)), path)
    return files.csv(s, path, "day string, attack_total long, blocked_total long, high_total long")


def quoted_csv(s: SparkSession, d: str) -> DataFrame:
    """Whole texts as quoted cells, of the named columns only, and read again."""
    docs, path = T.stored(s, d, "documents"), folder(s, "quoted")
    files.write_csv(docs.withColumn("cell", F.concat(F.lit(' "a",\n'), F.col("text"), F.lit(" "))), path, columns=("doc_id", "cell"))
    return files.csv(s, path, "doc_id long, cell string", lines=True).select("doc_id", F.md5("cell").alias("cell"))


def decoded_gb_payloads(s: SparkSession, d: str) -> DataFrame:
    """Labels in GB 18030 as hexadecimal digits, decoded."""
    packed = F.lit(None).cast("string")
    for label in LABELS:
        packed = F.when(F.col("label") == label, F.lit(f"attack={label}".encode("gb18030").hex())).otherwise(packed)
    return _label(s, d).groupBy(payloads.unhexed(packed).alias("decoded")).agg(F.count("*").alias("total"))


def host_forms(s: SparkSession, d: str) -> DataFrame:
    """Hosts of pages in the forms in which logs have them."""
    host, n = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1), F.col("page_id")
    text = F.when(n % 6 == 0, F.concat(F.lit("http://user:a@b@"), host, F.lit(":8080/x?y"))).when(n % 6 == 1, F.concat(F.lit(" "), F.upper(host), F.lit(":443 ")))
    text = text.when(n % 6 == 2, F.lit("https://[2001:DB8::1]:80/x")).when(n % 6 == 3, F.concat(host, F.lit("/Path"))).when(n % 6 == 4, F.lit("[::1]")).otherwise(F.concat(F.lit("1x://"), host, F.lit("/")))
    return T.stored(s, d, "pages").groupBy(http.host_name(text).alias("host")).agg(F.count("*").alias("total"))


def address_kinds(s: SparkSession, d: str) -> DataFrame:
    """Sources as IPv4 and IPv6 literals, in their shortest form, and whether they are public."""
    n, ip = F.col("number"), F.col("source_ip")
    text = F.when(n % 5 == 0, F.concat(F.lit("::FFFF:"), ip)).when(n % 5 == 1, F.concat(F.lit("2001:0db8:0:0:00:0:0:"), F.hex(n % 500 + 1)))
    text = text.when(n % 5 == 2, F.concat(F.lit("2A00:1450:0:0:0:0:0:"), F.hex(n % 500 + 1))).when(n % 5 == 3, F.concat(ip, F.lit(".1"))).otherwise(ip)
    rows = T.security_events(s, d).select(addresses.canonical_address(text).alias("address"), addresses.is_public(text).alias("is_public"))
    return rows.groupBy("address", "is_public").agg(F.count("*").alias("total"))


def block_modes(s: SparkSession, d: str) -> DataFrame:
    """Addresses to block by mode."""
    destination = F.when(F.col("number") % 3 == 0, F.lit("9.9.9.9")).when(F.col("number") % 3 == 1, F.lit("none"))
    rows = T.security_events(s, d)
    made = [F.array_join(cases.block_candidates(F.col("source_ip"), F.lit("src_ip=7.7.7.7"), mode=m, destination=destination), ",").alias(m) for m in ("source", "target", "both")]
    return rows.select("event_id", *made)


def checked_settings(s: SparkSession, d: str) -> DataFrame:
    """Settings that users gave, in plain form or with what is wrong, and whether the users' names are allowed."""
    n = F.col("o_orderkey")
    keys = F.array(*map(F.lit, ("capture_batch_size", "monitor_ports", "auto_refresh_seconds", "sound_alert_enabled", "theme", " ")))
    value = F.when(n % 6 == 1, F.concat((n % 90000).cast("string"), F.lit(", 080 "), (n % 90000).cast("string"))).when(n % 6 == 3, (n % 3).cast("string")).otherwise(F.concat(F.lit("+"), (n % 200).cast("string")))
    made = checks.setting(F.element_at(keys, (n % 6 + 1).cast("int")), value)
    name = F.when(n % 2 == 0, F.concat(F.lit("user_"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("u-"), F.col("o_custkey").cast("string")))
    return T.stored(s, d, "orders").select("o_orderkey", made.alias("m"), checks.is_username(name).alias("allowed")).select("o_orderkey", "m.name", "m.value", "m.error", "allowed")


def user_log(s: SparkSession, d: str) -> DataFrame:
    """The second page of one user's log."""
    logs = T.action_logs(s, d)
    last = events.user_log(logs, " user7 ", size=4).collect()
    return events.user_log(logs, "user7", last[-1], size=4) if last else logs.where("false")


def numbered_cases(s: SparkSession, d: str) -> DataFrame:
    """Requests numbered in their capture files, written as batches of text, and read again."""
    r = canonical.numbered(T.requests(s, d).select("file_id", "seq_id", "uri").withColumns({"request_block": F.col("uri"), "response_block": F.lit("r")}), 4)
    named = r.withColumn("file_id", F.concat(F.lit("1."), "file_id", F.lit("."), F.col("batch").cast("string")))
    return canonical.parsed(canonical.batch_texts(named)).select("file_id", "place", "seq_id", "uri")


def captured_files(s: SparkSession, d: str) -> DataFrame:
    """Requests written as capture files, followed as a stream of files, and parsed as they come."""
    captures.register(s)
    path, place, n = folder(s, "captures"), folder(s), F.floor(F.col("seq_id") / 50)
    r = T.requests(s, d).select("seq_id", "method", "uri", F.concat(F.lit("1.1."), n.cast("string")).alias("file_id"), n.alias("batch")).withColumns({"request_block": F.col("uri"), "response_block": F.lit("é")})
    canonical.batch_texts(r).select(F.col("batch").alias("number"), "value").write.format("captures").mode("append").save(path)
    stream = s.readStream.format("captures").option("stableSeconds", 0).load(path)
    jobs.drain(stream, lambda df, i: canonical.parsed(df.select("file_id", "value")).select("file_id", "seq_id", "method", "uri").write.mode("overwrite").parquet(f"{place}/batch={i:09d}"), place)
    return s.read.parquet(f"{place}/batch=*")


def run_metrics(s: SparkSession, d: str) -> DataFrame:
    """Rows of each stage from requests to exported candidates, counted by the one action that makes the export."""
    run = runs.Run(s)
    requests = run.stage("requests", T.requests(s, d))
    kept = run.stage("without static files", requests.where(~http.is_static(F.col("uri"))))
    scored = kept.select("file_id", "seq_id", (F.col("seq_id") * 37 % 101 / 10).alias("score"))
    ranked = run.stage("ranked", ranking.rerank(scored))
    top = run.stage("top", ranking.top_candidates(ranked, 5))
    top.write.parquet(folder(s, "export"))
    return run.report()


def stream_run_metrics(s: SparkSession, d: str) -> DataFrame:
    """Rows of each stage of a stream, summed over its micro-batches."""
    run, place = runs.StreamRun.attach(s), folder(s)
    read = run.stage("events", T.derived_events(jobs.source(s, d, "events")))
    high = run.stage("high", read.where("risk_level = 'high'"))
    jobs.drain(high.select("event_id"), lambda df, n: df.write.mode("overwrite").parquet(f"{place}/batch={n:09d}"), place)
    return run.report(s)


def committed_events(s: SparkSession, d: str) -> DataFrame:
    """Events after committed changes by two writers: one acknowledges, meanwhile the other sets a status; then some are noted and some deleted."""
    rows = T.security_events(s, d).select("event_id", "number", "risk_level", "process_status", "acked", "note")
    table = Table.create_from(s, folder(s, "events"), rows, ["event_id"], buckets=4)
    other, done = Table(s, table.root), []

    def acknowledge(base: DataFrame) -> DataFrame:
        if not done:  # the other writer commits before this one does
            done.append(other.apply(lambda r: mutations.set_status(r, F.col("risk_level") == "low", "done")))
        return mutations.acknowledge(base, F.col("risk_level") == "high")

    table.apply(acknowledge)
    noted = rows.where("number % 50 = 0").withColumn("note", F.concat(F.lit("seen "), "event_id"))
    table.upsert(noted, keep=("process_status", "acked"))
    table.delete_keys(rows.where("number % 70 = 1").select("event_id"))
    return table.rows().drop("number")


def earlier_version(s: SparkSession, d: str) -> DataFrame:
    """Statuses as they were before the last change."""
    rows = T.security_events(s, d).select("event_id", "risk_level", "process_status", "acked")
    table = Table.create_from(s, folder(s, "events"), rows, ["event_id"], buckets=4)
    before = table.apply(lambda r: mutations.set_status(r, F.col("risk_level") == "medium", "ignored"))
    table.delete_keys(rows.where("risk_level = 'low'").select("event_id"))
    return table.rows(before).groupBy("process_status", "acked").agg(F.count("*").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        decoded_texts, json_documents, forgiven_knowledge, case_documents, newest_cases, report_file, quoted_csv, decoded_gb_payloads, host_forms, address_kinds, block_modes, checked_settings, user_log,
        numbered_cases, run_metrics, stream_run_metrics, committed_events, earlier_version, captured_files,
    )
}
