import re

import pytest

from palisade.llm import mixing


def water_fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by rounds: clamp those above, reshare the rest by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        want = {s: left * weight[s] / total for s in free}
        over = [s for s in free if want[s] > most * sizes[s]]
        if not over:
            return fixed | want
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


def test_targets_match_rounds_of_clamping(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = water_fill(sizes)
    got = mixing.plan(docs).collect()
    taken, largest = {}, max(r["size"] for r in got)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest / 2 + 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixed_has_each_row_as_often_as_planned(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    times = {r["doc_id"]: r["times"] for r in mixing.plan(docs).collect()}
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    count = {r["doc_id"]: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert count == {k: v for k, v in times.items() if v}


def test_nulls_ties_repeats_and_empty_tables(spark, table):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, None), (None, "x y", None), (3, "", "t"), (4, "w " * 5000, "s")]
    docs = table(rows)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    assert {r["source"]: r["source_size"] for r in got} == {"s": 5006, None: 2, "t": 0}
    again = [r["taken"] for r in got if r["doc_id"] == 1]
    assert again[0] == again[1]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan(docs).collect()), key=str)
    assert mixing.plan(docs.where("false")).count() == 0
    assert mixing.mixed(docs.where("false")).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_no_document_of_a_clamped_source_exceeds_the_epochs(spark, table):
    # source a is small and has the greatest weight, so it is clamped at two epochs and nothing is left for a third
    rows = [(i, "w " * (i % 4), "a") for i in range(60)] + [(100 + i, "w " * 50, "b") for i in range(60)] + [(300 + i, "", "c") for i in range(9)]
    docs = table(rows)
    plan = mixing.plan(docs).collect()
    assert {r["target"] for r in plan if r["source"] == "a"} == {2.0 * sum(i % 4 for i in range(60))}
    assert {r["times"] for r in plan if r["source"] == "a"} == {2} and max(r["times"] for r in plan) <= 2
    count = {r["doc_id"]: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert max(count.values()) <= 2 and all(count[i] == 2 for i in range(60))
