"""Keyed merges, updates and deletes as functions from tables to tables.

Parquet tables are not changed in place: each function returns the new table,
which a job writes beside the old one and then swaps in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], version: list[Column]) -> DataFrame:
    """The row of each key with the greatest version."""
    order = Window.partitionBy(*key).orderBy(*[v.desc() for v in version])
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def upsert(base: DataFrame, delta: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the rows of ``delta`` put in by key; ``keep`` names columns whose stored values stay.

    ``delta`` has one row a key (see ``latest``). One full outer join; every column decides by presence, not by null.
    """
    b = base.select(*key, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in base.columns if c not in key])
    d = delta.select(*key, F.lit(True).alias("_d"), *[F.col(c).alias(f"d_{c}") for c in base.columns if c not in key])
    both = b.join(d, key, "full_outer")
    here = {c: F.col("_b") if c in keep else F.col("_d").isNull() for c in base.columns if c not in key}
    return both.select(*[F.col(c) if c in key else F.when(here[c], F.col(f"b_{c}")).otherwise(F.col(f"d_{c}")).alias(c) for c in base.columns])


def seed(base: DataFrame, defaults: DataFrame, key: list[str]) -> DataFrame:
    """``base`` and those rows of ``defaults`` whose keys it lacks."""
    return base.unionByName(defaults.join(base.select(*key), key, "left_anti"))


def delete(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key), key, "left_anti")


def replace_all(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Delete by key, then insert."""
    return delete(base, rows, key).unionByName(rows)


def set_columns(base: DataFrame, hit: Column, values: dict[str, Column]) -> DataFrame:
    """Single columns of the rows that are hit: a note, a password, a restart's time and status."""
    return base.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def cached_regions(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """The cache of regions (ip, region, source) after new answers; an answer without a region is a fallback, and does not replace a known one."""
    answer = asked.select("ip", F.coalesce(F.nullif(F.trim("region"), F.lit("")), F.lit("未知")).alias("region"), F.when(F.length(F.trim("region")) > 0, "remote").otherwise("fallback").alias("source"))
    known = cache.where("source = 'remote'").select("ip")
    return upsert(cache, answer.where("source = 'remote'").unionByName(answer.where("source <> 'remote'").join(known, "ip", "left_anti")), ["ip"])


def logged(logs: DataFrame, done: DataFrame) -> DataFrame:
    """The action log with further rows; ids go on after the greatest one, in order of time and user, in two steps as in ``export_cases``."""
    columns = [c for c in logs.columns if c != "id"]
    last = logs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    day = F.to_date("created_at")
    counts = done.groupBy(day.alias("_day")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a day
    starts = counts.select("_day", before.alias("_before")).crossJoin(last)
    inside = F.row_number().over(Window.partitionBy("_day").orderBy("created_at", "username", "action"))
    new = done.withColumn("_day", day).join(starts, "_day").select((F.col("last") + F.col("_before") + inside).cast("long").alias("id"), *columns)
    return logs.unionByName(new)


def acknowledge(events: DataFrame, hit: Column) -> DataFrame:
    status = F.when(hit & (F.col("process_status") == "unprocessed"), "processing").otherwise(F.col("process_status"))
    return events.withColumns({"acked": F.when(hit, 1).otherwise(F.col("acked")), "process_status": status})


def set_status(events: DataFrame, hit: Column, status: str) -> DataFrame:
    """Done and ignored events count as acknowledged."""
    if status not in ("unprocessed", "processing", "done", "ignored"):
        raise ValueError(f"no such status: {status}")
    acked = F.when(hit & F.lit(status in ("done", "ignored")), 1).otherwise(F.col("acked"))
    return events.withColumns({"process_status": F.when(hit, status).otherwise(F.col("process_status")), "acked": acked})


def block(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """Blocks with the sources of ``events``; an address belongs to the latest event that blocked it."""
    new = events.groupBy("source_ip").agg(F.max(F.struct("occurred_at", "event_id", "risk_level")).alias("l"))
    new = new.select(
        F.col("source_ip").alias("ip_address"), F.col("l.event_id").alias("source_event_id"), F.col("l.occurred_at").alias("blocked_at"),
        F.concat(F.lit("risk "), F.col("l.risk_level")).alias("reason"),
    )
    return upsert(blocks, new, ["ip_address"])


def export_cases(candidates: DataFrame, manifest: DataFrame, least: float, update: bool = False) -> DataFrame:
    """The manifest after an export: candidates from ``least`` on; known keys are skipped, or rewritten with ``update``.

    New cases get the numbers after the greatest known one, in order of file and
    sequence. They are numbered in two steps, by file and inside a file, so no
    window holds all of them.
    """
    key = ["file_id", "seq_id"]
    chosen = latest(candidates.where(F.col("raw_score") >= least), key, [-F.col("rank")])
    new = chosen.join(manifest.select(*key), key, "left_anti")
    counts = new.groupBy("file_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = manifest.agg(F.coalesce(F.max("case_no"), F.lit(0)).alias("last"))
    starts = counts.select("file_id", before.alias("before")).crossJoin(first)
    inside = F.row_number().over(Window.partitionBy("file_id").orderBy("seq_id"))
    added = new.join(starts, "file_id").select(*key, (F.col("last") + F.col("before") + inside).cast("long").alias("case_no"), "raw_score", F.lit("pending").alias("status"))
    known = manifest
    if update:
        again = chosen.select(*key, F.col("raw_score").alias("new_score"))
        known = manifest.join(again, key, "left").select(*key, "case_no", F.coalesce("new_score", "raw_score").alias("raw_score"), "status")
    return known.unionByName(added)
