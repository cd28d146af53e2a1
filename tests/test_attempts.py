"""Folds over sorted rows, tries of files and passes over cases, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.operators import passes, sequences
from palisade.sources.staging import folder
from palisade.streaming import attempts

START = datetime(2024, 1, 1)


def plain_tries(polls, most, rest):
    state = {}
    for name, at, ok, error in polls:
        n, kind, failed, last = state.get(name, (0, "failed", None, None))
        if kind in ("done", "ignored") or (failed and (at - failed).total_seconds() < rest):
            continue
        state[name] = (0, "done", None, None) if ok else (n + 1, "ignored" if n + 1 >= most else "failed", at, error)
    return state


def test_tries_over_batches_and_a_restart(spark):
    rng, rows, at = random.Random(4), [], START
    for i in range(300):
        at += timedelta(seconds=rng.randrange(9))
        rows.append((f"f{rng.randrange(12)}", at, rng.random() < 0.08, f"e{i}"))
    path, place = folder(spark, "polls"), folder(spark, "tries")
    kind = "file_id string, at timestamp, ok boolean, error string"
    stream = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    put = lambda i, some: spark.createDataFrame(some, kind).coalesce(1).write.parquet(f"{path}/part-{i}")
    put(0, [*rows[:100], (None, START, False, "x"), ("f1", None, False, "x")])
    put(1, rows[100:170])
    attempts.recorded(spark, stream(), place, most=4, rest=30, buckets=4)
    put(2, rows[170:])
    table = attempts.recorded(spark, stream(), place, most=4, rest=30, buckets=4)
    found = {r["file_id"]: (r["attempts"], r["state"], r["failed_at"], r["error"]) for r in table.rows().collect()}
    assert found == plain_tries(rows, 4, 30)
    assert {s for _, s, _, _ in found.values()} >= {"ignored", "done"}
    assert len(table.numbers()) == 2  # older versions are gone


def test_rest_and_states_decide_what_is_due(spark):
    rows = spark.createDataFrame([("failed", None), ("failed", START), ("done", None), ("ignored", START)], "state string, failed_at timestamp")
    due = lambda seconds: [r[0] for r in rows.select(attempts.due(F.col("state"), F.col("failed_at"), F.lit(START + timedelta(seconds=seconds)), 30)).collect()]
    assert due(29) == [True, False, False, False] and due(30) == [True, True, False, False]


@pytest.mark.parametrize("most", [0, 1, 7, 500, 5000])
def test_first_by_counts_instead_of_sorting(spark, monkeypatch, most):
    monkeypatch.setattr(sequences, "BLOCKS", 5)
    values = random.Random(7).sample(range(-10**6, 10**9), 900) + [0, 10**15]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "n long")
    assert sorted(r["n"] for r in sequences.first_by(rows, "n", most).collect()) == sorted(values)[:most]
    assert sequences.first_by(rows.where("n > 1e18"), "n", 3).count() == 0


def test_folds_carry_a_key_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = spark.createDataFrame([(k, i) for i in range(20) for k in "ab"], "k string, v long")
    found = sequences.folded(rows, "k", ["v"], lambda r: (r.k, []), lambda s, r: (s[0], [*s[1], r.v]), lambda s: (s[0], ",".join(map(str, s[1]))), "k string, seen string")
    wanted = ",".join(map(str, range(20)))
    assert sorted(map(tuple, found.collect())) == [("a", wanted), ("b", wanted)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def asker():
    def ask(model, text):
        if text == "bad" or (text == "slow" and model == "first"):
            raise RuntimeError("request timed out" if text == "slow" else "no JSON")

    return ask


def case_table(spark):
    kinds = ["good", "bad", "slow"]
    rows = [(f"b.{i}", i, kinds[i % 3], "pending", None, None, None) for i in range(9)]
    rows += [("b.20", 20, "good", "done", None, "first", None), ("b.21", 21, "good", "processing", START, None, None), ("b.22", 22, "good", "processing", START + timedelta(hours=2), None, None)]
    return passes.Cases(spark, folder(spark, "cases"), spark.createDataFrame(rows, passes.CASE), buckets=3)


def states(cases):
    return {r["number"]: (r["status"], r["model"]) for r in cases.rows().collect()}


def test_passes_take_the_first_cases_and_ask_a_second_model(spark):
    cases, now = case_table(spark), "2024-01-01 01:00:00"
    cases.run(now, asker(), ["first", "second"], most=4)
    found = states(cases)
    assert [found[i] for i in range(5)] == [("done", "first"), ("failed", None), ("done", "second"), ("done", "first"), ("pending", None)]
    assert found[21] == ("pending", None) and found[22] == ("processing", None)  # stale, and not
    cases.run(now, asker(), ["first"])
    found = states(cases)
    assert found[5] == ("failed", None) and found[8] == ("failed", None) and found[21] == ("done", "first") and found[22][0] == "processing"
    errors = {r["number"]: r["error"] for r in cases.rows().where("error IS NOT NULL").collect()}
    assert errors == {1: "no JSON", 4: "no JSON", 7: "no JSON", 5: "request timed out", 8: "request timed out"}


def test_a_pass_that_dies_is_taken_up_once_its_time_is_over(spark):
    cases = case_table(spark)
    cases.begin("2024-01-01 01:00:00", 3)  # and nothing after it
    assert [states(cases)[i][0] for i in range(4)] == ["processing"] * 3 + ["pending"]
    taken = lambda now: sorted(r["case_id"] for r in cases.run(now, asker(), ["first", "second"], 2).collect())
    assert taken("2024-01-01 01:02:59") == ["b.3", "b.4"]
    assert taken("2024-01-01 01:03:00") == ["b.0", "b.1"]
