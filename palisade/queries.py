"""The engine's registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import case_queries
from palisade.functions import addresses, http, labels, times
from palisade.operators import mutations, pairing, ranking
from palisade.plans import dashboard, evaluation, events, retrieval
from palisade.sources import canonical
from palisade.sources import tables as T
from palisade.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
ADDRESS_KEYWORD = events.EventQuery(preset="7d", risk="medium", attack="XSS", status="done", keyword="1", page=2, page_size=10)


def _of_events(plan: Callable, *more: Callable, **options) -> Query:
    """A plan over security events and further tables."""
    return lambda s, d: plan(T.security_events(s, d), *[m(s, d) for m in more], **options)


def _dated(query: Query) -> Query:
    """With the day as text."""
    return lambda s, d: query(s, d).withColumn("day", F.col("day").cast("string"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of events by file: a file is a group of users."""
    e = T.stored(s, d, "events")
    file_id = F.concat(F.lit("batch-"), (F.col("user_id") % 50).cast("string"))
    return e.select(file_id.alias("file_id"), F.col("event_id").alias("seq_id"), F.round("value", 1).alias("score"))


def _judged(s: SparkSession, d: str) -> DataFrame:
    """Scores between 0 and 1 with the truth."""
    attack = F.when(F.col("event_type").isin("error", "click"), 1).otherwise(0)
    return T.stored(s, d, "events").select(F.col("event_id").alias("seq_id"), (F.col("value") / 500.0).alias("score"), attack.alias("is_attack"))


def _raw_labels(s: SparkSession, d: str, strict: bool) -> DataFrame:
    kind = F.col("event_type")
    raw = F.concat(F.lit("x "), F.when(kind == "signup", "Brute_Force").when(kind == "error", "SQL-Injection").otherwise(kind))
    return T.stored(s, d, "events").select("event_id", labels.attack_label(raw, strict).alias("attack_label"))


def inferred_attacks(s: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws("\n", "uri", "response")
    return T.requests(s, d).select("seq_id", labels.inferred_attack(text).alias("attack_type"))


def risk_levels(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    severity = F.when(n % 9 == 0, F.when(F.col("event_type") == "error", "Critical").otherwise(" low"))
    confidence = F.when(n % 2 == 0, F.col("value") / 100)
    label = F.when(F.col("user_id") % 3 == 0, "suspicious").otherwise("benign")
    return T.stored(s, d, "events").select("event_id", labels.risk(severity, confidence, F.col("value") / 200, label).alias("risk_level"))


def attack_results(s: SparkSession, d: str) -> DataFrame:
    return T.requests(s, d).select("seq_id", "status_code", labels.attack_result(F.col("status_code")).alias("attack_result"))


def public_sources(s: SparkSession, d: str) -> DataFrame:
    by_ip = T.security_events(s, d).groupBy("source_ip").agg(F.count("*").alias("total"))
    return by_ip.select("source_ip", addresses.is_public(F.col("source_ip")).alias("is_public"), "total")


def static_requests(s: SparkSession, d: str) -> DataFrame:
    return T.requests(s, d).groupBy("host").agg(F.count("*").alias("total"), F.count_if(http.is_static(F.col("uri"))).alias("dropped"))


def query_terms(s: SparkSession, d: str) -> DataFrame:
    return T.stored(s, d, "documents").select("doc_id", F.array_join(http.query_terms(F.col("text")), " ").alias("terms"))


def host_names(s: SparkSession, d: str) -> DataFrame:
    return T.stored(s, d, "pages").groupBy(http.host_name(F.col("url")).alias("host")).agg(F.count("*").alias("total"))


def masked_documents(s: SparkSession, d: str) -> DataFrame:
    return T.stored(s, d, "documents").select("doc_id", F.sha2(http.masked(F.col("text")), 256).alias("masked_sha256"))


def flow_features(s: SparkSession, d: str) -> DataFrame:
    r = T.requests(s, d).withColumn("time", F.col("seq_id").cast("double")).withColumn("resp_time", F.col("time") + F.length("response") / 100000)
    return http.flow_features(r)


def candidate_requests(s: SparkSession, d: str) -> DataFrame:
    r = T.requests(s, d)
    parsed = r.where("seq_id % 2 = 0").select("file_id", "seq_id", F.when(F.col("seq_id") % 5 != 0, F.col("host")).alias("host"), "method")
    chosen = r.select("file_id", "seq_id", (F.col("seq_id") % 17).alias("raw_score"))
    return ranking.with_requests(chosen, parsed, r.select("file_id", "seq_id", "host", "method"), ["host", "method"])


def merged_sources(s: SparkSession, d: str) -> DataFrame:
    r = T.requests(s, d)
    first = r.where("seq_id % 3 > 0").select("file_id", "seq_id", "host", "method")
    second = r.where("seq_id % 2 = 0").select("file_id", "seq_id", F.when(F.col("seq_id") % 4 != 0, F.upper("host")).alias("host"), "status_code")
    return ranking.merged(first, second)


def micro_batches(s: SparkSession, d: str) -> DataFrame:
    return ranking.micro_batches(T.requests(s, d).select("file_id", "seq_id"), 4).select("file_id", "batch", "seq_id")


def _turns(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Requests and responses: user and assistant turns. Even conversations name the response, odd ones mostly the request."""
    frame, length = F.col("conv_id") * 1000 + F.col("turn"), F.length("text").alias("status_code")
    t = T.stored(s, d, "conversations").withColumn("frame_no", frame).withColumn("block_no", frame)
    requests = t.where("role = 'user'").select("frame_no", "block_no", F.when(F.col("conv_id") % 2 == 0, frame + 1).alias("response_frame"))
    names = (F.col("conv_id") % 2 == 1) & (F.col("conv_id") % 3 > 0)
    responses = t.where("role = 'assistant'").select("frame_no", "block_no", F.when(names, frame - 1).alias("request_frame"), length)
    return requests, responses


def paired_by_frame(s: SparkSession, d: str) -> DataFrame:
    return pairing.by_frame(*_turns(s, d))


def orphan_responses(s: SparkSession, d: str) -> DataFrame:
    requests, responses = _turns(s, d)
    return pairing.orphans(requests, responses.withColumn("request_frame", F.col("frame_no") - 1)).select("frame_no")


def paired_in_order(s: SparkSession, d: str) -> DataFrame:
    packets = T.stored(s, d, "conversations").where("role IN ('user', 'assistant')")
    return pairing.in_order(packets.select(F.col("conv_id").alias("stream"), F.col("turn").alias("place"), (F.col("role") == "user").alias("is_request")))


def upserted_events(s: SparkSession, d: str) -> DataFrame:
    e = T.security_events(s, d)
    base = e.where("number % 3 > 0").select("event_id", "risk_level", "process_status", "acked", "note")
    delta = e.where("number % 2 = 0").select("event_id", F.lit("high").alias("risk_level"), F.lit("unprocessed").alias("process_status"), F.lit(0).alias("acked"), F.lit(None).cast("string").alias("note"))
    return mutations.upsert(base, delta, ["event_id"], keep=("process_status", "acked", "note"))


def acknowledged(s: SparkSession, d: str) -> DataFrame:
    return mutations.acknowledge(T.security_events(s, d), F.col("risk_level") == "high").select("event_id", "acked", "process_status")


def batch_status(s: SparkSession, d: str) -> DataFrame:
    return mutations.set_status(T.security_events(s, d), F.col("risk_level") == "low", "done").select("event_id", "process_status", "acked")


def blocked_upsert(s: SparkSession, d: str) -> DataFrame:
    return mutations.block(T.blocked_ips(s, d), T.security_events(s, d).where("number % 17 = 0"))


def unblocked(s: SparkSession, d: str) -> DataFrame:
    gone = T.security_events(s, d).where("number % 19 = 0").select(F.col("source_ip").alias("ip_address"))
    return mutations.delete(T.blocked_ips(s, d), gone, ["ip_address"])


def exported_cases(s: SparkSession, d: str) -> DataFrame:
    scored = _scores(s, d).withColumn("raw_score", F.col("score")).withColumn("rank", F.lit(1))
    known = scored.where("raw_score >= 60 AND seq_id % 3 = 0").select("file_id", "seq_id", (F.col("seq_id") + 1).alias("case_no"), "raw_score", F.lit("done").alias("status"))
    return mutations.export_cases(scored, known, 60)


def config_seed(s: SparkSession, d: str) -> DataFrame:
    stored = T.stored(s, d, "region").where("r_regionkey < 3").select(F.col("r_name").alias("config_key"), F.lit("stored").alias("config_value"))
    defaults = T.stored(s, d, "nation").select(F.col("n_name").alias("config_key"), F.lit("default").alias("config_value"))
    return mutations.seed(stored, defaults, ["config_key"])


def score_coverage(s: SparkSession, d: str) -> DataFrame:
    truth = _judged(s, d)
    return evaluation.coverage(truth, truth.where("seq_id % 6 > 0"))


def document_search(s: SparkSession, d: str) -> DataFrame:
    return retrieval.search(T.stored(s, d, "documents"), "license").select("doc_id", "source")


def set_operations(s: SparkSession, d: str) -> DataFrame:
    a = T.stored(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    b = T.stored(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    made = (("union", a.union(b).distinct()), ("difference", b.subtract(a)), ("intersection", a.intersect(b)))
    counts = [x.agg(F.lit(name).alias("kind"), F.count("*").alias("total")) for name, x in made]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def refused_requests(s: SparkSession, d: str) -> DataFrame:
    """Events of sources that are blocked now, by node."""
    blocked = T.blocked_ips(s, d).select(F.col("ip_address").alias("source_ip"))
    return T.security_events(s, d).join(blocked, "source_ip", "left_semi").groupBy("target_node").agg(F.count("*").alias("refused"))


def admitted_requests(s: SparkSession, d: str) -> DataFrame:
    blocked = T.blocked_ips(s, d).select(F.col("ip_address").alias("source_ip"))
    return T.security_events(s, d).join(blocked, "source_ip", "left_anti").groupBy("target_node").agg(F.count("*").alias("admitted"))


def score_summary(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).groupBy("file_id").agg(F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("total"))


def lenient_times(s: SparkSession, d: str) -> DataFrame:
    """Order dates written in several ways and read back; every 50th is unreadable and becomes ``AS_OF``."""
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(n % 50 == 0, "soon").when(n % 4 == 0, F.concat(day, F.lit("T00:00:00Z"))).when(n % 4 == 1, F.concat(day, F.lit(" 00:00"))).when(n % 4 == 2, F.concat(day, F.lit("T00:00:00.250+08:00"))).otherwise(F.concat(day, F.lit(" 00:00:00")))
    return T.stored(s, d, "orders").select("o_orderkey", times.shown(times.lenient(text, F.lit(T.AS_OF).cast("timestamp"))).alias("shown"))


def traced_uris(s: SparkSession, d: str) -> DataFrame:
    r = T.requests(s, d)
    return r.select("seq_id", times.with_trace(F.col("uri"), F.format_string("bench_%04d", (F.col("seq_id") % 10000).cast("int"))).alias("uri"), times.rule_name(F.col("uri")).alias("rule"))


def model_requests(s: SparkSession, d: str) -> DataFrame:
    """One request by its key: the filter reaches the scan."""
    return T.requests(s, d).where("seq_id = 42").select("file_id", "seq_id", "method", "uri", "status_code")


def canonical_texts(s: SparkSession, d: str) -> DataFrame:
    """Requests with their whole responses as batches of canonical text."""
    n, answered = F.col("seq_id"), F.col("seq_id") % 5 > 0
    r = ranking.micro_batches(T.requests(s, d), 4).withColumns({
        "frame_req": n * 2, "frame_resp": F.when(answered, n * 2 + 1), "time_req": F.when(n % 3 > 0, n + 0.5), "time_resp": F.when(n % 2 > 0, n + 0.75), "src_ip": F.lit("1.2.3.4"), "dst_ip": F.lit("5.6.7.8"),
        "src_port": F.when(n % 4 > 0, 4000), "dst_port": F.lit(80), "request_text": F.concat(F.lit("URI="), F.col("uri"), F.lit("\nREQUEST_BODY="), F.hex(F.encode("host", "UTF-8"))),
        "response_text": F.lit("STATUS_CODE=1\nRESPONSE_EXCERPT=7b22617b22"), "request_block": F.col("uri"), "response_block": F.col("response"),
    })
    return canonical.batch_texts(r)


def canonical_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Requests written as batches of canonical text and read again."""
    back = canonical.parsed(canonical_texts(s, d))
    return back.select(
        "file_id", "place", "seq_id", "method", "uri", "host", "status_code", "content_type", F.length("request_text").alias("text_length"), "request_block",
        "frame_req", "frame_resp", "time_req", "time_resp", "src_ip", "src_port", "dst_port", "request_body", "response_excerpt", F.md5("response_block").alias("response_block"),
    )


def case_states(s: SparkSession, d: str) -> DataFrame:
    e = T.security_events(s, d)
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "done", "failed"))), (F.col("number") % 4 + 1).cast("int"))
    now = F.lit(T.AS_OF).cast("timestamp")
    began = F.date_trunc("second", F.col("occurred_at").cast("timestamp"))  # as cases have it
    return e.groupBy(jobs.case_state(status, F.when(F.col("number") % 6 > 0, began), now).alias("state"), status.alias("status")).agg(F.count("*").alias("total"))


def retry_states(s: SparkSession, d: str) -> DataFrame:
    e, now = T.security_events(s, d), F.lit(T.AS_OF).cast("timestamp")
    state = jobs.retry_state(F.col("number") % 7, F.when(F.col("number") % 3 > 0, F.col("occurred_at").cast("timestamp")), now)
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("total"))


QUERIES: dict[str, Query] = {
    "kpis": _of_events(dashboard.kpis, T.machines),
    "trend7d": _dated(_of_events(dashboard.trend7d)),
    "top_attack_types": _of_events(dashboard.top_attack_types),
    "method_share": _of_events(dashboard.method_share),
    "source_distribution": _of_events(dashboard.source_distribution, T.geo_cache),
    "heatmap": _of_events(dashboard.heatmap),
    "machine_ranking": _of_events(dashboard.machine_ranking),
    "daily_report": _dated(_of_events(dashboard.daily_report)),
    "admin_trend": _dated(_of_events(dashboard.admin_trend)),
    "model_performance": _dated(lambda s, d: dashboard.model_performance(T.model_metrics(s, d), "1998-06-30")),
    "response_histogram": _of_events(dashboard.response_histogram),
    "node_detail": _of_events(dashboard.node_detail, node="node-03"),
    "node_counts": _of_events(dashboard.node_counts),
    "machine_statistics": _of_events(dashboard.machine_statistics, T.machines),
    "system_status": _of_events(dashboard.system_status, T.machines),
    "admin_summary": _of_events(dashboard.admin_summary, T.machines),
    "blocked_by_event": lambda s, d: events.blocked_by_event(T.blocked_ips(s, d)),
    "event_search": _of_events(ADDRESS_KEYWORD.rows, T.blocked_ips),
    "event_search_total": _of_events(ADDRESS_KEYWORD.total),
    "events_with_blocks": lambda s, d: events.with_blocks(T.security_events(s, d), T.blocked_ips(s, d)).select("event_id", "source_ip", "is_blocked"),
    "event_detail": _of_events(events.detail, T.blocked_ips, T.geo_cache, event_id="EVT000000650"),
    "alert_ticker": _of_events(events.ticker, most=10),
    "alert_popup": _of_events(events.popup, most=20),
    "node_latest": _of_events(events.latest_of_node, node="node-05"),
    "each_node_latest": _of_events(events.latest_of_each_node),
    "blocked_list": lambda s, d: events.blocked_list(T.blocked_ips(s, d), "1_.", page=2),
    "screen_attacks": lambda s, d: events.screen_attacks(T.analyses(s, d)),
    "screen_attacks_done": lambda s, d: events.screen_attacks(T.analyses(s, d), "done", 50, 20),
    "case_by_id": lambda s, d: events.case_rows(T.analyses(s, d), case_id="b.37"),
    "case_by_place": lambda s, d: events.case_rows(T.analyses(s, d), file_id="batch-7", seq_id="57"),
    "users": lambda s, d: events.users(T.accounts(s, d)),
    "user_actions": lambda s, d: events.user_actions(T.action_logs(s, d), "1-urgent", page=2),
    "labels_default": lambda s, d: _raw_labels(s, d, strict=False),
    "labels_strict": lambda s, d: _raw_labels(s, d, strict=True),
    "model_input": lambda s, d: http.model_input(T.requests(s, d)),
    "reranked": lambda s, d: ranking.rerank(_scores(s, d)),
    "top_candidates": lambda s, d: ranking.top_candidates(ranking.rerank(_scores(s, d)), 5),
    "threshold_sweep": lambda s, d: evaluation.sweep(_judged(s, d)),
    "best_threshold": lambda s, d: evaluation.best(evaluation.sweep(_judged(s, d))),
    "stream_hourly_counts": jobs.hourly_counts,
    "stream_latest_by_user": jobs.latest_by_user,
    "stream_paired_packets": jobs.paired_packets,
    "bm25": lambda s, d: retrieval.bm25(T.stored(s, d, "documents"), ["the", "license", "re on"], ["text"], 20),
} | {
    f.__name__: f
    for f in (
        inferred_attacks, risk_levels, attack_results, public_sources, static_requests, query_terms, host_names, masked_documents, flow_features,
        candidate_requests, merged_sources, micro_batches, paired_by_frame, orphan_responses, paired_in_order, upserted_events, acknowledged,
        batch_status, blocked_upsert, unblocked, exported_cases, config_seed, score_coverage, document_search, set_operations,
        canonical_round_trip, case_states, retry_states, refused_requests, admitted_requests, score_summary, lenient_times,
        traced_uris, model_requests,
    )
} | case_queries.QUERIES
