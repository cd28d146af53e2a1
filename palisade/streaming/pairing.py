"""Responses paired with requests as packets arrive, over all streams, with state that is touched entry by entry.

A response may name the frame of its request, whatever stream that came in; without
a name, or with one that no request has or had by then, it answers the oldest
request that waits in its own stream. Two steps with state do this:

1. By frame: a request leaves its stream's name, and a response that names it is sent
   on to that stream.
2. By stream: waiting requests lie in a map from their frame to their number, and in
   one from the number to the frame, which is the queue: its first and next numbers
   are the only other state. A batch reads and writes the entries it needs, so what
   it costs follows its packets and not the requests that wait.

A named request of another stream that was answered before it could be taken leaves
its response over. Such responses are written aside and come back as packets
without a name, after the packets that came meanwhile; this is the one case in
which the order of arrival isn't kept. Frames are unique. Waiting requests, and the
streams of frames that no response names, stay in the state. A task holds the
packets that one stream has in a micro-batch, whose files the source limits.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.sources.versions import Log

PACKET = "stream long, frame long, place long, is_request boolean, named long"
ROUTED = "at long, stream long, frame long, place long, is_request boolean, named long"
PAIR = "stream long, request long, response long, place long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ByFrame(StatefulProcessor):
    """Sends each packet to the stream where it counts. State: the stream of a request's frame, until a response names it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stream = handle.getValueState("stream", "stream long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r["place"]):  # the packets of one frame
            at, named = r["stream"], None
            if r["is_request"]:
                self.stream.update((r["stream"],))
            elif r["named"] is not None and self.stream.exists():
                at, named = self.stream.get()[0], r["named"]
                self.stream.clear()
            yield Row(at=at, stream=r["stream"], frame=r["frame"], place=r["place"], is_request=r["is_request"], named=named)

    def close(self) -> None:
        pass


class ByStream(StatefulProcessor):
    """Gives pairs; a pair without a request is a response that is left over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.number = handle.getMapState("number", "frame long", "number long")
        self.frame = handle.getMapState("frame", "number long", "frame long")
        self.ends = handle.getValueState("ends", "first long, next long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, following = self.ends.get() if self.ends.exists() else (0, 0)
        came: dict[int, int] = {}  # frame and number of this batch's requests that still wait
        queue: dict[int, int] = {}  # the same the other way round
        for r in sorted(rows, key=lambda r: r["place"]):
            answered = None
            if r["is_request"]:
                came[r["frame"]], queue[following] = following, r["frame"]
                following += 1
                continue
            named = r["named"]
            if named is not None and named in came:
                del queue[came.pop(named)]
                answered = named
            elif named is not None and self.number.containsKey((named,)):
                self.frame.removeKey(self.number.getValue((named,)))
                self.number.removeKey((named,))
                answered = named
            elif named is None or r["stream"] == r["at"]:
                while first < following and answered is None:
                    if first in queue:
                        answered = queue.pop(first)
                        del came[answered]
                    elif self.frame.containsKey((first,)):
                        answered = self.frame.getValue((first,))[0]
                        self.frame.removeKey((first,))
                        self.number.removeKey((answered,))
                    first += 1
                if answered is None:
                    continue  # nobody waits
            yield Row(stream=r["stream"], request=answered, response=r["frame"], place=r["place"])
        for frame, number in came.items():
            self.number.updateValue((frame,), (number,))
            self.frame.updateValue((number,), (frame,))
        self.ends.update((first, following))

    def close(self) -> None:
        pass


def paired(spark: SparkSession, packets: DataFrame, place: str) -> DataFrame:
    """stream (of the response), request and response (frames) of a stream of ``PACKET`` rows; ``place`` goes on from an earlier run.

    Packets are taken in order of ``place`` inside a micro-batch, and micro-batches as they come.
    """
    log, late = Log(spark, place), f"{place}/late"
    if not log.names("late"):
        spark.createDataFrame([], PACKET).write.mode("append").parquet(late)
    back = spark.readStream.schema(PACKET).option("recursiveFileLookup", True).parquet(late)
    every = packets.select(*back.columns).unionByName(back)
    keyed = every.withColumn("key", F.coalesce(F.when(~F.col("is_request"), F.col("named")), "frame"))
    routed = keyed.groupBy("key").transformWithState(ByFrame(), ROUTED, "Append", "None")
    found = routed.groupBy("at").transformWithState(ByStream(), PAIR, "Append", "None")

    def keep(df: DataFrame, n: int) -> None:
        df = df.persist()
        df.where("request IS NOT NULL").select("stream", "request", "response").write.mode("overwrite").parquet(f"{place}/pairs/batch={n:09d}")
        left = df.where("request IS NULL")
        if not left.isEmpty():
            kind = left.select("stream", F.col("response").alias("frame"), "place", F.lit(False).alias("is_request"), F.lit(None).cast("long").alias("named"))
            kind.write.mode("overwrite").parquet(f"{late}/batch={n:09d}")
        df.unpersist()

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)
    try:
        over = None
        while over is None or over != log.names("late"):  # once more where responses were left over
            over = log.names("late")
            job = found.writeStream.option("checkpointLocation", f"{place}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
            job.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("stream long, request long, response long").parquet(f"{place}/pairs/batch=*")
