"""Aggregates of the dashboard over security events.

Each endpoint is one plan with one aggregation over one scan: conditional counts
instead of several statements. ``as_of`` stands for now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import labels
from palisade.sources.tables import AS_OF


def _day() -> Column:
    return F.to_date("occurred_at")


def _today(as_of: str) -> Column:
    return F.to_date(F.lit(as_of))


def _share(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole > 0, part * 100.0 / whole).otherwise(0.0), digits)


def _since(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Events of the last ``days`` days, today included; there is no upper bound."""
    return events.where(F.col("occurred_at") >= F.date_sub(_today(as_of), days - 1))


def _rolling(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Events from ``days`` times 24 hours ago on; there is no upper bound."""
    return events.where(F.col("occurred_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def kpis(events: DataFrame, machines: DataFrame, as_of: str = AS_OF) -> DataFrame:
    today, blocked = _day() == _today(as_of), F.col("attack_result") == "blocked"
    one = events.agg(
        F.count_if(today).alias("today_count"),
        F.count_if(_day() == F.date_sub(_today(as_of), 1)).alias("yesterday_count"),
        F.count_if((F.col("risk_level") == "high") & F.col("process_status").isin("unprocessed", "processing")).alias("active_high"),
        F.count_if(today & blocked).alias("today_blocked"),
        F.coalesce(F.round(F.avg(F.when(today, F.col("response_ms"))), 2), F.lit(0.0)).alias("avg_response_ms"),
        F.count_if(today & (F.col("anomaly_detected") == 1)).alias("today_anomalies"),
    )
    nodes = machines.agg(F.count_if(F.col("online_status") == "online").alias("online_nodes"))
    change = F.when(F.col("yesterday_count") > 0, (F.col("today_count") - F.col("yesterday_count")) * 100.0 / F.col("yesterday_count")).otherwise(0.0)
    out = one.crossJoin(nodes)  # one row each
    return out.withColumn("day_over_day_percent", F.round(change, 2)).withColumn("blocked_percent", _share(F.col("today_blocked"), F.col("today_count")))


def spine(events: DataFrame, as_of: str, days: int) -> DataFrame:
    one = events.sparkSession.range(1)
    return one.select(F.explode(F.sequence(F.date_sub(_today(as_of), days - 1), _today(as_of))).alias("day"))


def trend7d(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """All of the last seven days, also those without events; the days with most events are peaks."""
    by_day = _since(events, as_of, 7).groupBy(_day().alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("attack_result") == "blocked").alias("blocked"))
    full = spine(events, as_of, 7).join(by_day, "day", "left").fillna(0, ["total", "blocked"])
    peak = full.agg(F.max("total").alias("peak"))
    return full.crossJoin(peak).select("day", "total", "blocked", F.when((F.col("total") == F.col("peak")) & (F.col("total") > 0), 1).otherwise(0).alias("is_peak"))


def attack_types(events: DataFrame, as_of: str = AS_OF, days: int = 7) -> DataFrame:
    return _rolling(events, as_of, days).groupBy(labels.attack_label(F.col("attack_type")).alias("attack_label")).agg(F.count("*").alias("total"))


def top_attack_types(events: DataFrame, as_of: str = AS_OF, most: int = 10) -> DataFrame:
    return attack_types(events, as_of).orderBy(F.desc("total"), "attack_label").limit(most)


def method_share(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    by_type = attack_types(events, as_of)
    whole = by_type.agg(F.sum("total").alias("whole"))
    return by_type.crossJoin(whole).select("attack_label", "total", _share(F.col("total"), F.col("whole")).alias("ratio_percent"))


def source_distribution(events: DataFrame, geo: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Events by region: counted by address first, so only one row for each address meets the cache."""
    by_ip = _rolling(events, as_of, 7).groupBy("source_ip").agg(F.count("*").alias("total"))
    octet = F.split_part("source_ip", F.lit("."), F.lit(1)).cast("int")
    found = by_ip.withColumn("first_octet", octet).join(geo, "first_octet", "left")
    name = labels.region(F.col("source_ip"), F.lit(None).cast("string"), F.col("region"))
    return found.groupBy(name.alias("source_region")).agg(F.sum("total").alias("total"), F.count("*").alias("addresses"))


def heatmap(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return _rolling(events, as_of, 30).groupBy(F.weekday("occurred_at").alias("weekday"), F.hour("occurred_at").alias("hour")).agg(F.count("*").alias("total"))


def machine_ranking(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return events.where(_day() == _today(as_of)).groupBy(F.col("target_node").alias("machine_name")).agg(F.count("*").alias("total"))


def daily_report(events: DataFrame, as_of: str = AS_OF, days: int = 30) -> DataFrame:
    """Days with events only, from ``days`` days before today on."""
    return _since(events, as_of, days + 1).groupBy(_day().alias("day")).agg(
        F.count("*").alias("attack_total"), F.count_if(F.col("attack_result") == "blocked").alias("blocked_total"), F.count_if(F.col("risk_level") == "high").alias("high_total")
    )


def admin_trend(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return _since(events, as_of, 7).groupBy(_day().alias("day")).agg(F.count("*").alias("total"))


def model_performance(metrics: DataFrame, until: str, days: int = 30) -> DataFrame:
    recent = metrics.where(F.col("metric_time") >= F.date_sub(F.lit(until).cast("date"), days))
    return recent.groupBy(F.to_date("metric_time").alias("day")).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("drift_score", "accuracy", "recall_rate", "inference_ms")])


def response_histogram(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Four fixed buckets, from one pass over the events."""
    ms, cuts = F.col("response_ms"), ((None, 100), (100, 300), (300, 800), (800, None))
    names = ("<100ms", "100-300ms", "300-800ms", ">=800ms")
    inside = [(F.lit(True) if lo is None else ms >= lo) & (F.lit(True) if hi is None else ms < hi) for lo, hi in cuts]
    one = _rolling(events, as_of, 30).agg(*[F.count_if(c).alias(f"b{i}") for i, c in enumerate(inside)])
    return one.select(F.stack(F.lit(4), *[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"b{i}"))]).alias("bucket", "total"))


def node_detail(events: DataFrame, node: str, as_of: str = AS_OF) -> DataFrame:
    of = _rolling(events, as_of, 7).where(F.col("target_node") == node)
    return of.agg(F.count("*").alias("total_7d"), F.count_if(F.col("attack_result") == "blocked").alias("blocked_7d"), F.count_if(F.col("risk_level") == "high").alias("high_7d"))


def node_counts(events: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """For each node: events of today, those of them that are high and open, and its latest event."""
    today, open_ = _day() == _today(as_of), F.col("process_status").isin("unprocessed", "processing")
    return events.groupBy("target_node").agg(
        F.count_if(today).alias("today_count"),
        F.count_if(today & (F.col("risk_level") == "high") & open_).alias("alert_count"),
        F.max("occurred_at").alias("latest"),
    )


def machine_statistics(events: DataFrame, machines: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The machine dimension with refreshed counts; machines without events get 0."""
    counts = node_counts(events, as_of)
    joined = machines.join(counts, F.col("machine_name") == F.col("target_node"), "left")
    return joined.select(
        "id", "machine_name", "online_status", F.coalesce("today_count", F.lit(0)).alias("today_attack_count"),
        F.coalesce("alert_count", F.lit(0)).alias("current_alert_count"), F.col("latest").alias("last_event"),
    )


def system_status(events: DataFrame, machines: DataFrame, as_of: str = AS_OF) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    one = events.agg(
        F.max("occurred_at").alias("latest_data_time"),
        F.count_if((F.col("risk_level") == "high") & (F.col("occurred_at") >= now - F.expr("INTERVAL 10 MINUTES"))).alias("high_risk_last_10m"),
    )
    off = machines.agg(F.count_if(F.col("online_status") != "online").alias("offline_machine_count"))
    level = F.when(F.col("offline_machine_count") > 0, "error").when(F.col("high_risk_last_10m") >= 8, "warning").otherwise("normal")
    return one.crossJoin(off).withColumn("level", level)


def admin_summary(events: DataFrame, machines: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Machines online, offline and with open alerts, and today's attacks."""
    of = machine_statistics(events, machines, as_of)
    online = F.col("online_status") == "online"
    counts = of.agg(
        F.count_if(online).alias("online_machine_total"), F.count_if(F.col("current_alert_count") > 0).alias("alert_machine_count"), F.count_if(~online).alias("offline_machine_count")
    )
    return counts.crossJoin(events.where(_day() == _today(as_of)).agg(F.count("*").alias("today_attack_total")))  # one row each
