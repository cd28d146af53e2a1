"""Requests with their responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key, by block number."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "block_no").alias("row")).select("row.*")


def by_frame(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Each request with the response that it names, else with the one that names it, else alone.

    requests: frame_no, response_frame, block_no; responses: frame_no, request_frame, block_no, status_code.
    Of rows with equal frame numbers the last counts.
    """
    requests = _last(requests, "frame_no")
    named = _last(responses, "frame_no").select(F.col("frame_no").alias("response_frame"), F.struct(F.col("frame_no").alias("frame"), "status_code").alias("first"))
    naming = _last(responses.where("request_frame IS NOT NULL"), "request_frame")
    naming = naming.select(F.col("request_frame").alias("frame_no"), F.struct(F.col("frame_no").alias("frame"), "status_code").alias("second"))
    joined = requests.join(named, "response_frame", "left").join(naming, "frame_no", "left")
    found = F.coalesce("first", "second")
    return joined.select("frame_no", found["frame"].alias("response_frame"), found["status_code"].alias("status_code"))


def orphans(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that name a request which is not there."""
    known = requests.select(F.col("frame_no").alias("request_frame"))
    return responses.where("request_frame IS NOT NULL").join(known, "request_frame", "left_anti")


def in_order(packets: DataFrame) -> DataFrame:
    """First in, first out in each stream: the k-th response answers the k-th request, if that came before it.

    packets: stream, place (order in the stream), is_request. A response that
    comes with nothing pending is dropped. With r requests and s accepted responses so far, a response is
    accepted if s < r; the accepted count follows from the least balance so far, so no state is carried by hand.
    """
    so_far = Window.partitionBy("stream").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("is_request"), 1).otherwise(-1)
    balance = packets.withColumn("balance", F.sum(step).over(so_far))
    # what was dropped so far is how far the plain balance ever fell below 0
    dropped = balance.withColumn("dropped", F.greatest(F.lit(0), -F.min("balance").over(so_far)))
    before = Window.partitionBy("stream").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    marked = dropped.withColumn("lost", (~F.col("is_request")) & (F.col("dropped") > F.coalesce(F.max("dropped").over(before), F.lit(0))))
    kept = marked.where(~F.col("lost"))
    turn = Window.partitionBy("stream", "is_request").orderBy("place")
    numbered = kept.withColumn("turn", F.row_number().over(turn))
    pick = lambda flag: F.max(F.when(F.col("is_request") == flag, F.col("place")))
    pairs = numbered.groupBy("stream", "turn").agg(pick(True).alias("request_place"), pick(False).alias("response_place"))
    return pairs.where("request_place IS NOT NULL AND response_place IS NOT NULL")
