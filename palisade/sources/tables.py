"""Engine tables derived from the stored ones with plain column expressions.

Each derivation only projects, so filters and column choices reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day and time that queries take as now; every plan takes another as an argument.
AS_OF = "2024-01-29 18:30:00"
NODES = 8


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: one security event for each stored event."""
    return derived_events(stored(spark, sf_dir, "events"))


def derived_events(e: DataFrame) -> DataFrame:
    """Security events of stored ones, from a table or a stream."""
    n, user = F.col("event_id"), F.col("user_id")
    raw = (
        F.when(F.col("event_type") == "error", "sqli").when(F.col("event_type") == "click", "xss").when(F.col("event_type") == "signup", "brute force")
        .when(F.col("event_type") == "view", "port scan").otherwise("path traversal")
    )
    level = F.when(F.col("value") >= 80, "high").when(F.col("value") >= 30, "medium").otherwise("low")
    status = F.element_at(F.array(*map(F.lit, ("unprocessed", "processing", "done", "ignored"))), (n % 4 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("EVT"), F.lpad(n.cast("string"), 9, "0")).alias("event_id"),
        F.col("ts").alias("occurred_at"),
        level.alias("risk_level"),
        raw.alias("attack_type"),
        F.concat((10 + user % 190).cast("string"), F.lit("."), (n % 7).cast("string"), F.lit(".0."), (user % 250 + 1).cast("string")).alias("source_ip"),
        F.concat(F.lit("node-"), F.lpad((user % NODES).cast("string"), 2, "0")).alias("target_node"),
        F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), (n % 100).cast("string")).alias("target_interface"),
        F.when(n % 10 < 8, "blocked").otherwise("success").alias("attack_result"),
        status.alias("process_status"),
        F.when(n % 4 >= 2, 1).otherwise(0).alias("acked"),
        F.floor(F.col("value") * 10).cast("long").alias("response_ms"),
        F.when((F.col("value") >= 80) | (n % 11 == 0), 1).otherwise(0).alias("anomaly_detected"),
        (user % NODES + 1).alias("machine_id"),
        F.col("props").alias("request_log"),
        F.when(n % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("note "), n.cast("string"))).alias("note"),
        F.col("value").alias("score"),
        n.alias("number"),
    )


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine dimension: one for each supplier; those after the first ``NODES`` have no events."""
    s = stored(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        F.format_string("node-%02d", F.col("s_suppkey") - 1).alias("machine_name"),
        F.when(F.col("s_suppkey") % 4 == 0, "offline").otherwise("online").alias("online_status"),
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows of the detection model: one for each lineitem, by its shipping time."""
    li = stored(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_shipdate").alias("metric_time"),
        F.concat(F.lit("node-"), F.lpad((F.col("l_suppkey") % NODES).cast("string"), 2, "0")).alias("node_name"),
        F.col("l_discount").alias("drift_score"),
        (1 - F.col("l_tax")).alias("accuracy"),
        (1 - F.col("l_discount")).alias("recall_rate"),
        F.col("l_quantity").alias("inference_ms"),
    )


def blocked_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks: each 13th event blocked its source; an address is attributed to its latest event."""
    e = security_events(spark, sf_dir).where("number % 13 = 0")
    latest = e.groupBy("source_ip").agg(F.max(F.struct("occurred_at", "event_id", "risk_level")).alias("l"))
    return latest.select(
        F.col("source_ip").alias("ip_address"), F.col("l.event_id").alias("source_event_id"), F.col("l.occurred_at").alias("blocked_at"),
        F.concat(F.lit("risk "), F.col("l.risk_level")).alias("reason"),
    )


def action_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of users: one for each order."""
    o = stored(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("username"),
        F.when(F.col("o_orderstatus") == "P", "admin").otherwise("normal").alias("role"),
        F.lower(F.col("o_orderpriority")).alias("action"), F.col("o_orderdate").alias("created_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP requests: one for each page, parsed from its url."""
    p = stored(spark, sf_dir, "pages")
    after = F.regexp_extract("url", r"(?s)^[^:]*://[^/?#]*(.*)$", 1)
    n = F.col("page_id")
    return p.select(
        F.concat(F.lit("batch-"), (n % 50).cast("string")).alias("file_id"),
        n.alias("seq_id"),
        F.when(n % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.coalesce(F.nullif(after, F.lit("")), F.lit("/")).alias("uri"),
        F.lower(F.regexp_extract("url", r"(?s)^[^:]*://([^/?#]*)", 1)).alias("host"),
        F.when(n % 7 == 0, 404).when(n % 11 == 0, 500).otherwise(200).alias("status_code"),
        F.when(n % 3 == 0, "application/json").otherwise("text/html").alias("content_type"),
        F.concat(F.lit("agent/"), (n % 9).cast("string")).alias("user_agent"),
        F.col("html").alias("body"),
        F.col("html").alias("response"),
    )


def geo_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of first octets, as a remote look-up would have filled the cache."""
    n = stored(spark, sf_dir, "nation")
    return n.select((F.col("n_nationkey") * 8 + 10).cast("int").alias("first_octet"), F.col("n_name").alias("region"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of cases: one for each stored event; some have no event time or an empty one."""
    n, statuses = F.col("number"), F.array(*map(F.lit, ("pending", "processing", "done", "failed")))
    shown = F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss")
    return security_events(spark, sf_dir).select(
        F.concat(F.lit("b."), n.cast("string")).alias("case_id"), F.concat(F.lit("batch-"), (n % 50).cast("string")).alias("file_id"), n.alias("seq_id"),
        F.when(n % 5 == 0, F.lit(None)).when(n % 7 == 0, F.lit("")).otherwise(shown).alias("attack_event_time"), F.col("source_ip").alias("attack_ip"),
        "target_interface", "attack_type", (F.col("score") / 100).alias("attack_confidence"), F.element_at(statuses, (n % 4 + 1).cast("int")).alias("llm_status"),
        F.col("occurred_at").alias("updated_at"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts: one for each customer."""
    key = F.col("c_custkey")
    role = F.when(key % 7 == 0, "admin").when(key % 7 < 5, "normal").otherwise("guest")
    return stored(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lit("user"), key.cast("string")).alias("username"), role.alias("role"), F.col("c_name").alias("display_name"))
