"""Tries of files: failures with their times, a rest after each, and files that are given up.

A poll of a file counts as a try unless the file is done or given up, or rests
after a failure. The table of files is committed version by version (see
``palisade.sources.versions``), once for each micro-batch and no second time when a
micro-batch is repeated.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import mutations, sequences
from palisade.sources.versions import Table
from palisade.streaming import jobs

COLUMNS = "file_id string, attempts int, state string, failed_at timestamp, error string"


class Tries(NamedTuple):
    file_id: str
    attempts: int = 0
    state: str = "failed"
    failed_at: object = None
    error: str | None = None


def _value(x: object) -> object:
    return None if x is None or x != x else x


def counted(polls: DataFrame, known: DataFrame, most: int, rest: int) -> DataFrame:
    """Files of ``polls`` (file_id, at, ok, error) as they are after them; ``known`` holds files as they were before."""
    before = known.select("file_id", *[F.col(c).alias(f"was_{c}") for c in ("attempts", "state", "failed_at", "error")])

    def start(r) -> Tries:
        return Tries(r.file_id) if _value(r.was_state) is None else Tries(r.file_id, int(r.was_attempts), r.was_state, _value(r.was_failed_at), _value(r.was_error))

    def step(t: Tries, r) -> Tries:
        resting = t.failed_at is not None and (r.at - t.failed_at).total_seconds() < rest
        if t.state in ("done", "ignored") or resting:
            return t
        if r.ok:
            return Tries(t.file_id, 0, "done")
        return Tries(t.file_id, t.attempts + 1, "ignored" if t.attempts + 1 >= most else "failed", r.at, _value(r.error))

    return sequences.folded(polls.join(before, "file_id", "left"), "file_id", ["at", "error"], start, step, tuple, COLUMNS)


def recorded(spark: SparkSession, polls: DataFrame, place: str, most: int = 5, rest: int = 30, buckets: int = 64) -> Table:
    """The table of files after a stream of polls; ``place`` goes on from an earlier run."""
    table = Table(spark, f"{place}/files")
    if not table.numbers():
        Table.create_from(spark, table.root, spark.createDataFrame([], COLUMNS), ["file_id"], buckets)

    def record(df: DataFrame, n: int) -> None:
        table.apply(lambda base: mutations.upsert(base, counted(df, base, most, rest), ["file_id"]), df.where("file_id IS NOT NULL"), n)
        table.expire(keep=2)

    jobs.drain(polls.where("file_id IS NOT NULL AND at IS NOT NULL"), record, place)
    return table


def due(state: Column, failed_at: Column, now: Column, rest: int = 30) -> Column:
    """Whether a file may be tried: it is neither done nor given up, and has rested."""
    rested = failed_at.isNull() | (F.unix_micros(now) - F.unix_micros(failed_at) >= rest * 1_000_000)
    return ~state.isin("done", "ignored") & rested
