"""Streams of packets and events: pairing with state, hourly counts, keyed merges, case states.

Each job is a Structured Streaming query over a file source with a checkpoint:
a file is taken once, and a run that is given the folder of an earlier one goes
on where that ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.operators import mutations
from palisade.sources.staging import folder
from palisade.sources.versions import Log, Table
from palisade.streaming import pairing


# Parts of errors after which a case is tried again.
RETRIED = ("timed out", "connection refused", "winerror 10061", "llama runner process has terminated", "http 500", "internal server error")


def source(spark: SparkSession, sf_dir: str, name: str, files: int = 8) -> DataFrame:
    """A table's files as a stream, at most ``files`` of them in a micro-batch."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # a stream reads the files of a folder: those of the table, or, of a table in one file, that file by its name
    first = table.inputFiles()[0] if table.inputFiles() else f"{sf_dir}/{name}.parquet"
    single = first.rstrip("/").endswith(f"/{name}.parquet")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else stream.parquet(f"{sf_dir}/{name}.parquet")


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], place: str, mode: str = "append") -> None:
    """Run all that is there, batch by batch, and end."""
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(each).trigger(availableNow=True).start()
    job.awaitTermination()


def hourly_counts(spark: SparkSession, sf_dir: str, place: str | None = None) -> DataFrame:
    """Events by hour and type: each micro-batch's counts are written, and added up at the end, so no event comes too late.

    With the ``place`` of an earlier run only files that came since are read, and their counts are added.
    """
    place = place or folder(spark)
    events = source(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))

    def partial(df: DataFrame, n: int) -> None:
        counts = df.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") >= 80).alias("high"))
        flat = counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "total", "high")
        flat.write.mode("overwrite").parquet(f"{place}/batch={n:09d}")

    drain(events, partial, place)
    rows = spark.read.option("basePath", place).parquet(place + "/batch=*")
    return rows.groupBy("hour", "event_type").agg(F.sum("total").alias("total"), F.sum("high").alias("high"))


def latest_by_user(spark: SparkSession, sf_dir: str, place: str | None = None) -> DataFrame:
    """A keyed table kept up to date: each batch is merged into the buckets of its users and committed as a version. ``place`` goes on from an earlier run."""
    columns, place = ("user_id", "event_id", "event_type"), place or folder(spark)
    table = Table(spark, f"{place}/table")
    if not table.numbers():
        Table.create_from(spark, table.root, spark.createDataFrame([], "user_id long, event_id long, event_type string"), ["user_id"])

    def newer(base: DataFrame, delta: DataFrame) -> DataFrame:
        old = base.select("user_id", F.col("event_id").alias("old"))
        return delta.join(old, "user_id", "left").where("old IS NULL OR event_id > old").drop("old")

    def merge(df: DataFrame, n: int) -> None:
        last = df.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("r")).select("user_id", "r.*")
        table.apply(lambda base: mutations.upsert(base, newer(base, last), ["user_id"]), last, n)
        table.expire(keep=2)

    drain(source(spark, sf_dir, "events").select(*columns), merge, place)
    return table.rows()


PLACES = 1 << 24  # packets of a stream at most; streams are numbers below 2**39


def paired(spark: SparkSession, packets: DataFrame, place: str | None = None) -> DataFrame:
    """Pairs of a stream of packets (stream, place, is_request, request_place), as they arrive; ``place`` goes on from an earlier run.

    Places are unique in their stream only, and a response names a request of its own stream. A response without a name,
    or whose request does not wait, answers the oldest request that waits (see ``palisade.streaming.pairing``).
    """
    frame = lambda c: (F.col("stream") * PLACES + F.col(c)).cast("long")
    rows = packets.select(F.col("stream").cast("long"), frame("place").alias("frame"), F.col("place").cast("long"), "is_request", frame("request_place").alias("named"))
    found = pairing.paired(spark, rows, place or folder(spark))
    return found.select("stream", (F.col("request") % PLACES).alias("request_place"), (F.col("response") % PLACES).alias("response_place"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = source(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    return turns.select(F.col("conv_id").alias("stream"), F.col("turn").alias("place"), (F.col("role") == "user").alias("is_request"))


def paired_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request and response turns of each conversation, paired as they arrive."""
    return paired(spark, _turns(spark, sf_dir).withColumn("request_place", F.lit(None).cast("long")))


def paired_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where responses of every third turn name the request two turns before."""
    names = F.when(~F.col("is_request") & (F.col("place") % 3 == 0), F.col("place") - 2)
    return paired(spark, _turns(spark, sf_dir).withColumn("request_place", names.cast("long")))


def counted_batches(stream: DataFrame, place: str, size: int, shard: str, order: str) -> DataFrame:
    """shard, batch and the rows of ``stream`` in batches of ``size``, as soon as one is full; the rest of a shard waits for more.

    Rows of a shard are numbered on in order of arrival, by ``order`` inside a micro-batch. The waiting rows, fewer
    than ``size`` a shard, and the number of batches so far are written with each micro-batch, and deleted two micro-batches
    later, when no repetition reads them any more.
    """
    spark, columns = stream.sparkSession, stream.columns
    log = Log(spark, place)

    def emit(df: DataFrame, n: int) -> None:
        rows = df.withColumn("_since", F.lit(n).cast("long"))
        if n > 0:
            rows = rows.unionByName(spark.read.parquet(f"{place}/tail/version={n - 1}"))
        rows = rows.persist()
        counts = rows.groupBy(shard).agg(F.count("*").alias("_n"))
        if n > 0:
            counts = counts.join(spark.read.parquet(f"{place}/done/version={n - 1}"), shard, "full_outer").fillna(0, ["_n", "_done"])
        else:
            counts = counts.withColumn("_done", F.lit(0).cast("long"))
        at = F.row_number().over(Window.partitionBy(shard).orderBy("_since", order)) - 1
        made = rows.withColumn("_at", at).join(counts, shard)
        full = F.floor(F.col("_at") / size) < F.floor(F.col("_n") / size)
        out = made.where(full).select(*columns, (F.col("_done") + F.floor(F.col("_at") / size)).alias("batch"))
        out.write.mode("overwrite").parquet(f"{place}/out/version={n}")
        made.where(~full).select(*columns, "_since").write.mode("overwrite").parquet(f"{place}/tail/version={n}")
        counts.select(shard, (F.col("_done") + F.floor(F.col("_n") / size)).alias("_done")).write.mode("overwrite").parquet(f"{place}/done/version={n}")
        for name in ("tail", "done"):
            log.delete(f"{name}/version={n - 2}")
        rows.unpersist()

    drain(stream, emit, place)
    return spark.read.option("basePath", f"{place}/out").parquet(f"{place}/out/version=*").drop("version")


def admitted(spark: SparkSession, stream: DataFrame, blocked: Callable[[], DataFrame], place: str | None = None) -> DataFrame:
    """Counts by node of the events whose source is not blocked; the list is read anew for each micro-batch."""
    place = place or folder(spark)

    def partial(df: DataFrame, n: int) -> None:
        free = df.join(blocked(), "source_ip", "left_anti")
        free.groupBy("target_node").agg(F.count("*").alias("admitted")).write.mode("overwrite").parquet(f"{place}/batch={n:09d}")

    drain(stream, partial, place)
    return spark.read.option("basePath", place).parquet(place + "/batch=*").groupBy("target_node").agg(F.sum("admitted").alias("admitted"))


def retry_state(attempts: Column, failed_at: Column, now: Column, most: int = 5, cooldown: int = 30) -> Column:
    """ready, waiting (the last failure is too recent) or ignored (too many failures)."""
    rested = failed_at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(failed_at) >= cooldown)
    return F.when(attempts >= most, "ignored").when(rested, "ready").otherwise("waiting")


def case_state(status: Column, started: Column, now: Column, timeout: int = 180) -> Column:
    """Which cases a pass takes: pending and failed ones, and those that have been processing for too long, parts of seconds included."""
    since = F.unix_micros(now) - F.unix_micros(started)
    stale = (status == "processing") & F.coalesce(since >= max(30, timeout) * 1_000_000, F.lit(True))  # without a start, nobody is at work
    return F.when(status.isin("pending", "failed") | stale, "take").otherwise("leave")


def can_retry(error: Column) -> Column:
    """Whether an error is worth another try."""
    low, found = F.lower(error), F.lit(False)
    for token in RETRIED:
        found = found | low.contains(token)
    return F.coalesce(found, F.lit(False))
