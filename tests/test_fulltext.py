"""The full-text index against searches that read all texts, and the folding of accents."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.plans import events, retrieval
from palisade.plans.fulltext import TextIndex

WORDS = "login Token tokén crème CREME brûlée password the a b admin-user x".split()


def documents(spark, seed, n=60):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))
    rows = [(i, text() if i % 9 else None, text(), f"s{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, title string, source string")


def same(index, docs):
    columns = ["text", "title"]
    for terms in (["login", "crème"], ["the admin user", "TOKEN password", "creme brulee"], ["x a b", "missing"]):
        rounded = [[(r["doc_id"], round(r["score"], 9)) for r in f(15).collect()] for f in (lambda k, t=terms: index.bm25(t, k), lambda k, t=terms: retrieval.bm25(docs, t, columns, k))]
        assert rounded[0] == rounded[1]
    for text, tag in (("admin-user login", None), ("creme", "s1"), ("", "s2"), ("", None)):
        found = retrieval.found(docs, text, tag, tuple(columns))
        assert index.total(text, tag).first()[0] == found.count()
        pages, before = [], None
        while page := index.search(text, tag, before, 4).collect():
            pages, before = pages + [r["doc_id"] for r in page], page[-1]["doc_id"]
        assert pages == [r["doc_id"] for r in found.orderBy(F.desc("doc_id")).collect()]


def test_index_finds_what_a_scan_finds_after_every_change(spark, tmp_path):
    docs = documents(spark, 1)
    index = TextIndex.create_from(spark, f"{tmp_path}/i", docs, ["text", "title"], buckets=4)
    same(index, docs)
    new = documents(spark, 2, 90).where("doc_id % 4 = 0")
    index.upsert(new)
    docs = docs.where("doc_id % 4 > 0").unionByName(new)
    index.delete_ids(docs.where("doc_id % 6 = 1").select("doc_id"))
    docs = docs.where("doc_id % 6 <> 1")
    index.upsert(new.limit(5))
    docs = docs.join(new.limit(5), "doc_id", "left_anti").unionByName(new.limit(5)) if new.limit(5).count() else docs
    same(index, docs)
    index.compact()
    same(index, docs)
    assert len(index.latest()[1]["segments"]) == 1 and not index.latest()[1]["dead"]


def test_only_the_buckets_of_the_terms_are_read(spark, tmp_path):
    index = TextIndex.create_from(spark, f"{tmp_path}/i", documents(spark, 3), ["text"], buckets=8)
    rows = index.postings(["login"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(token,login)" in plan
    assert len({f.rsplit("bucket=", 1)[1].split("/")[0] for f in rows.inputFiles()}) >= 1 and rows.select("bucket").distinct().count() == 1


def test_each_task_writes_its_own_postings(spark, tmp_path):
    index = TextIndex.create_from(spark, f"{tmp_path}/i", documents(spark, 4, 200).repartition(3), ["text", "title"], buckets=2)
    files = index.postings(["login"]).inputFiles()
    assert len(files) == 2 * 3  # of both buckets; by a shuffle to buckets there would be two
    same(index, documents(spark, 4, 200))


def test_phrases_stay_inside_a_column(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "c d", "s"), (2, "b c", "", "s")], "doc_id long, text string, title string, source string")
    index = TextIndex.create_from(spark, f"{tmp_path}/i", docs, ["text", "title"], buckets=2)
    assert [r["doc_id"] for r in index.bm25(["b c"], 5).collect()] == [2]
    with pytest.raises(ValueError, match="without a term"):
        index.total("ü")
    for terms, wanted in ((["b c"], [2]), (["B ", "q"], [1, 2]), (["zz"], []), ([], [])):
        hits = index.bm25(terms, 5) if terms else None
        for ranked in (hits, None):
            assert sorted(r["doc_id"] for r in retrieval.with_fallback(docs, terms, ["text"], 5, ranked=ranked).collect()) == wanted


def test_accents_do_not_matter(spark):
    texts = ["Crème Brûlée", "creme brulee", "CRÈME", "crème", "ÀÉÎÕÜ çñ", "straße ø", "日本 が", "İ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = [r[0].split() for r in rows.orderBy("i").select(retrieval.folded(F.col("text"))).collect()]
    assert found[:5] == [["creme", "brulee"], ["creme", "brulee"], ["creme"], ["creme"], ["aeiou", "cn"]]
    assert found[5] == ["straße", "ø"] and found[7] == ["i"]
    assert [retrieval.phrase_tokens(t) for t in texts[:6]] == found[:6]


def test_pages_by_key_chain_to_one_sort(spark):
    rows = spark.createDataFrame([(f"e{i:03}", (i * 7) % 10) for i in range(95)], "event_id string, score int")
    order, last, chained = (("score", True), ("event_id", False)), None, []
    while page := events.following(rows, order, last, 12).collect():
        chained, last = chained + page, page[-1]
    assert chained == rows.orderBy(F.desc("score"), "event_id").collect()
    plan = events.following(rows, order, chained[20], 12)._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan
