"""What a run did: the rows of each of its stages, counted while they pass."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from palisade.sources.files import counted

SCHEMA = "stage string, rows long"


class Run:
    """Stages of a batch run. A stage's rows are counted by the action that uses it, so no table is read for the count alone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seen = spark, dict[str, Observation]()

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, counted under ``name``."""
        if name in self.seen:
            raise ValueError(f"there is a stage {name}")
        out, self.seen[name] = counted(df, name)
        return out

    def report(self) -> DataFrame:
        """stage and rows of all stages; each must have been used by an action before."""
        return self.spark.createDataFrame([(name, seen.get["rows"]) for name, seen in self.seen.items()], SCHEMA)


class StreamRun(StreamingQueryListener):
    """Sums of the rows that stages of streams observed, over all micro-batches since ``attach``."""

    def __init__(self):
        self.rows, self.ended = dict[str, int](), threading.Event()

    @classmethod
    def attach(cls, spark: SparkSession) -> StreamRun:
        listener = cls()
        spark.streams.addListener(listener)
        return listener

    @staticmethod
    def stage(name: str, df: DataFrame) -> DataFrame:
        return df.observe(name, F.count("*").alias("rows"))

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        for name, seen in event.progress.observedMetrics.items():
            self.rows[name] = self.rows.get(name, 0) + seen["rows"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def report(self, spark: SparkSession, wait: float = 60) -> DataFrame:
        """stage and rows, once the stream that ran last has told that it ended."""
        self.ended.wait(wait)
        spark.streams.removeListener(self)
        return spark.createDataFrame(sorted(self.rows.items()), SCHEMA)
