"""Event search, lists and details: filters chained onto a frame, then one page of it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from palisade.functions import labels
from palisade.sources.tables import AS_OF

PRESETS = {"1h": timedelta(hours=1), "6h": timedelta(hours=6), "24h": timedelta(days=1), "7d": timedelta(days=7), "30d": timedelta(days=30)}
LISTED = ("event_id", "occurred_at", "risk_level", "attack_type", "source_ip", "target_node", "target_interface", "attack_result", "process_status", "acked")


def time_range(preset: str, as_of: str = AS_OF, start: str | None = None, end: str | None = None) -> tuple[str, str]:
    """First and last time of a preset; "custom" takes ISO times, whose zone is dropped; an unknown one is a day."""
    now = datetime.fromisoformat(as_of)
    if preset == "custom" and start and end:
        low, high = (datetime.fromisoformat(x.replace("Z", "+00:00")).replace(tzinfo=None) for x in (start, end))
        if low >= high:
            raise ValueError("start must be before end")
    else:
        low, high = now - PRESETS.get(preset, PRESETS["24h"]), now
    return low.isoformat(" "), high.isoformat(" ")


@dataclass(frozen=True)
class EventQuery:
    """A search over events. All given conditions must hold; ``keyword`` is a LIKE pattern's inside, so % and _ are wild."""

    preset: str = "24h"
    risk: str | None = None
    attack: str | None = None
    node: str | None = None
    status: str | None = None
    keyword: str | None = None
    page: int = 1
    page_size: int = 20
    as_of: str = AS_OF

    def filtered(self, events: DataFrame) -> DataFrame:
        low, high = time_range(self.preset, self.as_of)
        out = events.where(F.col("occurred_at").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
        for column, value in (("risk_level", self.risk), ("target_node", self.node), ("process_status", self.status)):
            if value:
                out = out.where(F.col(column) == value)
        if self.attack:
            out = out.where(F.lower("attack_type").isin(*(a.lower() for a in labels.ATTACK_ALIASES.get(self.attack, (self.attack,)))))
        if self.keyword:
            pattern = f"%{self.keyword.lower()}%"
            out = out.where(F.lower("event_id").like(pattern) | F.lower("source_ip").like(pattern) | F.lower("target_interface").like(pattern))
        return out

    def total(self, events: DataFrame) -> DataFrame:
        return self.filtered(events).agg(F.count("*").alias("total"))

    def rows(self, events: DataFrame, blocks: DataFrame) -> DataFrame:
        """One page, newest first, with the canonical label and whether the event led to a block."""
        size = min(200, max(1, self.page_size))
        page = self.filtered(events).select(*LISTED).orderBy(F.desc("occurred_at"), "event_id").offset((max(1, self.page) - 1) * size).limit(size)
        return with_blocks(page, blocks).withColumn("attack_type", labels.attack_label(F.col("attack_type")))


NEWEST = (("occurred_at", True), ("event_id", False))  # columns of an order, and whether they fall


def following(rows: DataFrame, order: tuple[tuple[str, bool], ...], last: Row | None, size: int) -> DataFrame:
    """The page behind ``last``, a row of the page before it or None for the first page, in an ``order`` that ends with a key.

    Rows up to ``last`` are filtered where the table is read, so the thousandth page costs no more than the first;
    an offset would have every task hold all rows before the page. The columns of the order must not be null.
    """
    if last is not None:
        behind, equal = F.lit(False), F.lit(True)
        for name, falls in order:
            c, value = F.col(name), F.lit(last[name]).cast(rows.schema[name].dataType)
            behind, equal = behind | (equal & (c < value if falls else c > value)), equal & (c == value)
        first, falls = order[0]
        bound = F.lit(last[first]).cast(rows.schema[first].dataType)
        rows = rows.where((F.col(first) <= bound if falls else F.col(first) >= bound) & behind)  # the plain bound reaches the scan
    return rows.orderBy(*[F.col(c).desc() if falls else F.col(c).asc() for c, falls in order]).limit(size)


def blocked_by_event(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("source_event_id").agg(F.max("blocked_at").alias("last_blocked_at"))


def with_blocks(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """Events with is_blocked, 1 where a block names the event."""
    led = blocked_by_event(blocks).select("source_event_id")
    joined = events.join(led, F.col("event_id") == F.col("source_event_id"), "left")
    return joined.select(*[events[c] for c in events.columns], F.col("source_event_id").isNotNull().cast("int").alias("is_blocked"))


def detail(events: DataFrame, blocks: DataFrame, geo: DataFrame, event_id: str) -> DataFrame:
    one = with_blocks(events.where(F.col("event_id") == event_id), blocks)
    one = one.withColumn("first_octet", F.split_part("source_ip", F.lit("."), F.lit(1)).cast("int")).join(geo, "first_octet", "left")
    name = labels.region(F.col("source_ip"), F.lit(None).cast("string"), F.col("region"))
    return one.select(
        "event_id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss.SSS").alias("occurred_at"), "risk_level",
        labels.attack_label(F.col("attack_type")).alias("attack_label"), "source_ip", name.alias("source_region"), "is_blocked", "request_log",
    )


ALERT = ("event_id", "occurred_at", "attack_type", "source_ip", "target_node", "target_interface")


def _latest(events: DataFrame, most: int, columns: tuple[str, ...]) -> DataFrame:
    return events.orderBy(F.desc("occurred_at"), "event_id").limit(most).select(*columns)


def ticker(events: DataFrame, most: int = 3) -> DataFrame:
    """The latest high alerts, 10 at most."""
    return _latest(events.where(F.col("risk_level") == "high"), min(10, max(1, most)), ("risk_level", *ALERT))


def popup(events: DataFrame, most: int = 5) -> DataFrame:
    """The latest high alerts that nobody has acknowledged, 20 at most."""
    return _latest(events.where((F.col("risk_level") == "high") & (F.col("acked") == 0)), min(20, max(1, most)), ALERT)


def latest_of_node(events: DataFrame, node: str, most: int = 50) -> DataFrame:
    columns = ("event_id", "occurred_at", "risk_level", "attack_type", "source_ip", "attack_result", "process_status")
    return _latest(events.where(F.col("target_node") == node), most, columns)


def latest_of_each_node(events: DataFrame, most: int = 50) -> DataFrame:
    """The latest events of every node: Spark keeps the first rows of a node in each task before it shuffles."""
    from pyspark.sql import Window

    order = Window.partitionBy("target_node").orderBy(F.desc("occurred_at"), "event_id")
    ranked = events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return ranked.select("target_node", "place", "event_id", "occurred_at")


def blocked_list(blocks: DataFrame, keyword: str = "", page: int = 1, size: int = 20) -> DataFrame:
    like = f"%{keyword.lower()}%"
    found = blocks.where(F.lower("ip_address").like(like) | F.lower("reason").like(like))
    return found.orderBy(F.desc("blocked_at"), "ip_address").offset((page - 1) * size).limit(size)


def screen_attacks(analyses: DataFrame, status: str = "", most: int = 100, offset: int = 0) -> DataFrame:
    """A page of analyses: those without an event time last, then the newest."""
    found = analyses.where(F.col("llm_status") == status) if status else analyses
    empty = F.when(F.col("attack_event_time").isNull() | (F.col("attack_event_time") == ""), 1).otherwise(0)
    page = found.orderBy(empty, F.desc("attack_event_time"), F.desc("updated_at"), "case_id").offset(max(0, offset)).limit(max(1, min(500, most)))
    return page.select(
        "case_id", "file_id", "seq_id", F.col("attack_event_time").alias("event_time"), "attack_ip", "target_interface", "attack_type",
        F.col("attack_confidence").alias("confidence"), "llm_status",
    )


def case_rows(rows: DataFrame, case_id: str = "", file_id: str = "", seq_id: str = "") -> DataFrame:
    """Rows of one case, by its id or else by its file and place there; the key reaches the scan."""
    if case_id.strip():
        return rows.where(F.col("case_id") == case_id.strip())
    try:
        place = int(seq_id) if seq_id.strip() else None
    except ValueError:
        raise ValueError("seq_id must be an integer") from None
    if not file_id.strip() or place is None:
        raise ValueError("give case_id, or file_id and seq_id")
    return rows.where((F.col("file_id") == file_id.strip()) & (F.col("seq_id") == place))


def users(accounts: DataFrame) -> DataFrame:
    """Administrators, then normal users, by name; other roles are left out."""
    of = accounts.where(F.col("role").isin("admin", "normal"))
    return of.orderBy(F.when(F.col("role") == "admin", 1).otherwise(2), "username").select("id", "username", "role", "display_name")


def user_actions(logs: DataFrame, action: str, page: int = 1, size: int = 50) -> DataFrame:
    """A page of one action's log; admins before all others."""
    role = F.when(F.col("role") == "admin", 0).otherwise(1)
    return logs.where(F.col("action") == action).orderBy(role, F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)


def user_log(logs: DataFrame, username: str = "", last: Row | None = None, size: int = 30) -> DataFrame:
    """A page of the action log, of one user or of all, newest first, behind the ``last`` row of the page before."""
    found = logs.where(F.col("username") == username.strip()) if username.strip() else logs
    return following(found, (("created_at", True), ("id", True)), last, max(1, min(200, size)))
