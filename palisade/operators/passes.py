"""Passes over cases that wait for an analysis.

A pass takes the first cases, by their number, that are pending or failed or whose
processing began too long ago, marks them as processing, asks, and writes what came
of it. Both steps are committed versions of the case table, so a pass that dies
between them leaves cases in processing, which a later pass takes up again once
their time is over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import mutations, sequences
from palisade.sources.staging import staged
from palisade.sources.versions import Table
from palisade.streaming import jobs

CASE = "case_id string, number long, text string, status string, started_at timestamp, model string, error string"
ANSWER = "case_id string, status string, model string, error string"


def retried(error: str) -> bool:
    return any(token in error.lower() for token in jobs.RETRIED)


def answered(cases: DataFrame, ask: Callable[[str, str], str], models: list[str]) -> DataFrame:
    """Status, model and error of each case: ``ask(model, text)`` answers or raises; after an error worth another try the next model is asked."""

    def one(text: str) -> tuple[str, str | None, str | None]:
        for i, model in enumerate(models):
            try:
                ask(model, text)
                return "done", model, None
            except Exception as e:  # whatever a remote model's client raises is the case's error
                error = str(e)
                if i + 1 == len(models) or not retried(error):
                    break
        return "failed", None, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(c, *one(t)) for c, t in zip(f["case_id"], f["text"], strict=True)], columns=["case_id", "status", "model", "error"])

    return cases.select("case_id", "text").mapInPandas(run, ANSWER)


class Cases:
    """A table of ``CASE`` rows; case_id is the key and no two cases have one number."""

    def __init__(self, spark: SparkSession, root: str, cases: DataFrame | None = None, buckets: int = 64):
        self.table = Table(spark, root) if cases is None else Table.create_from(spark, root, cases, ["case_id"], buckets)

    def begin(self, now: str, most: int, timeout: int = 180) -> DataFrame:
        """Take up at most ``most`` cases (0: all of them) at the time ``now``; stale ones that are not among them become pending."""
        at, rows = F.lit(now).cast("timestamp"), self.table.rows()
        open_ = rows.where(jobs.case_state(F.col("status"), F.col("started_at"), at, timeout) == "take")
        open_ = staged(open_.select("case_id", "number", "text", (F.col("status") == "processing").alias("stale")), "open-cases")
        chosen = sequences.first_by(open_, "number", most) if most > 0 else open_
        marks = chosen.select("case_id", F.lit("processing").alias("_status"), at.alias("_at"))
        recovered = open_.where("stale").join(chosen, "case_id", "left_anti").select("case_id", F.lit("pending").alias("_status"), F.lit(None).cast("timestamp").alias("_at"))
        marks = marks.unionByName(recovered)

        def mark(base: DataFrame) -> DataFrame:
            found, hit = base.join(marks, "case_id", "left"), F.col("_status").isNotNull()
            return mutations.set_columns(found, hit, {"status": F.col("_status"), "started_at": F.col("_at")}).select(base.columns)

        self.table.apply(mark, marks)
        return chosen

    def run(self, now: str, ask: Callable[[str, str], str], models: list[str], most: int = 0, timeout: int = 180) -> DataFrame:
        """One pass; the answers of the cases that it took. They are written before they are used, so no case is asked twice for one pass."""
        answers = staged(answered(self.begin(now, most, timeout), ask, models), "answers")
        news = answers.select("case_id", *[F.col(c).alias(f"_{c}") for c in ("status", "model", "error")])

        def put(base: DataFrame) -> DataFrame:
            found, hit = base.join(news, "case_id", "left"), F.col("_status").isNotNull()
            return mutations.set_columns(found, hit, {c: F.col(f"_{c}") for c in ("status", "model", "error")}).select(base.columns)

        self.table.apply(put, answers)
        self.table.expire(keep=2)
        return answers

    def rows(self) -> DataFrame:
        return self.table.rows()
