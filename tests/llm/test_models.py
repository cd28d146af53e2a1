"""Classifiers on held-out rows, and the language model against direct computation."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import labelled as labelled_rows
from palisade.llm import language_model, quality, toxicity


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def labelled(spark, seed=1, n=500):
    """Documents in which toxic words and shouting decide the labels."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 200))]
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = "vexqu" + word()
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)
        docs.append((i, text, "en"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("model", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, model, label):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    got = model.scored(docs, labels).collect()
    assert len(got) == 500 and all(r.held_out == (fold(r.doc_id) == 0) and 0 <= r.score <= 1 for r in got)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert sum(right) >= 0.95 * len(right)
    kept = model.kept(docs, labels)
    assert kept.columns == docs.columns
    keep = 0 if label == "toxic" else 1
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted == keep}


@pytest.mark.parametrize("model", [toxicity, quality])
def test_nulls_empty_long_and_unlabelled(spark, model):
    docs, labels = labelled(spark, n=60)
    odd = spark.createDataFrame([(900, None, "x"), (901, "", "x"), (901, "", "x"), (None, "a b", None), (902, "word " * 60_000, "x")], docs.schema)
    assert model.scored(odd, labels).count() == 5
    got = model.scored(docs.unionByName(odd), labels).where("doc_id = 901").collect()
    assert len(got) == 2 and got[0].score == got[1].score
    assert model.scored(docs.where("false"), labels).count() == 0
    assert model.kept(docs, labels.where("false")).count() == 60


@pytest.mark.parametrize("model", [toxicity, quality])
def test_clashing_columns_and_contradicting_labels(spark, model):
    docs, labels = labelled(spark, n=120)
    wide = docs.selectExpr("7 AS score", "doc_id", "'x' AS predicted", "text", "true AS held_out", "1.5D AS label", "array(1) AS quality", "lang")
    both = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality", "1 - toxic AS toxic").where("doc_id % 10 = 1"))
    kept = model.kept(wide, labels)
    assert kept.schema == wide.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in model.kept(docs, labels).collect()}
    texts, found = labelled_rows.sample(wide, both, "toxic", 1000)
    text = {r.text: r.doc_id for r in docs.collect()}
    assert all(y == 1 for t, y in zip(texts, found, strict=True) if text[t] % 10 == 1) and len(texts) == sum(fold(i) != 0 for i in range(120))
    assert model.scored(wide, both).columns == ["doc_id", "held_out", "score", "predicted"]


def test_the_sample_is_the_least_hashes_of_each_class(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = spark.range(6000).selectExpr("id AS doc_id", "cast(id % 3 = 0 AS int) AS toxic")
    order = {r.id: r.h for r in spark.range(6000).selectExpr("id", "xxhash64(id) AS h").collect()}
    texts, found = labelled_rows.sample(docs, labels, "toxic", 40)
    for value in (0, 1):
        of = sorted((i for i in range(6000) if (i % 3 == 0) == value and fold(i) != 0), key=order.get)[:40]
        assert {int(t[1:]) for t, y in zip(texts, found, strict=True) if y == value} == set(of)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_quality_scores_against_a_plain_computation(spark):
    docs, labels = labelled(spark, n=120)
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    plain = {}
    for r in docs.collect():
        x = quality.features(pa.array([r.text]))[0]
        plain[r.doc_id] = sum(w * (v - m) / s for w, v, m, s in zip(model.weights, x, model.mean, model.spread, strict=True))
        assert rows[r.doc_id].score == pytest.approx(sigmoid(model.scale * (plain[r.doc_id] - model.cut) + math.log(0.3 / 0.7)), abs=1e-9)
        assert rows[r.doc_id].predicted == int(plain[r.doc_id] >= model.cut - 1e-12)
    # the pairs' logistic loss is near its minimum: no step along one weight lowers it by much
    texts, y = labelled_rows.sample(docs, labels, "quality", quality.MOST)
    x = (quality.features(pa.array(texts)) - model.mean) / model.spread
    good, bad = x[np.array(y) == 1], x[np.array(y) == 0]
    loss = lambda w: np.log1p(np.exp(-((good @ w)[:, None] - (bad @ w)[None]))).mean() + 5e-4 * w @ w
    at = loss(model.weights)
    assert at < 0.3 * loss(np.zeros_like(model.weights))
    assert all(loss(model.weights + d * np.eye(len(model.weights))[k]) > at - 0.02 for k in range(len(model.weights)) for d in (-0.2, 0.2))


def test_recurrent_logits_against_a_plain_loop(spark):
    """One window after the other, one step after the other, as the equations stand in the papers."""
    docs, labels = labelled(spark, n=150)
    model = toxicity.fit(docs, labels)
    p, k = {n: v.astype(np.float64) for n, v in model.net.p.items()}, toxicity.HIDDEN
    texts = [r.text for r in docs.limit(12).collect()] + ["a", "vexquan " * 3, "b " * 70]
    got = model.scores(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        lex = toxicity.lexicon(pa.array([text]))
        x = model.inputs(lex).astype(np.float64)
        words, best, at = lex.index.tolist(), -math.inf, 0
        while True:
            window = [x[:, i] for i in words[at : at + toxicity.WINDOW]]
            size, window = len(window), window + [np.zeros(len(x))] * (toxicity.WINDOW - len(window))
            states = {}
            for d, order in (("f", range(toxicity.WINDOW)), ("b", range(toxicity.WINDOW - 1, -1, -1))):
                h = np.zeros(k)
                for t in order:
                    g = p[f"x{d}"] @ window[t]
                    zr = 1 / (1 + np.exp(-(p[f"zr{d}"] @ h + g[: 2 * k])))
                    new = np.tanh(p[f"n{d}"] @ (zr[k:] * h) + g[2 * k :])
                    h = (1 - zr[:k]) * h + zr[:k] * new
                    states[d, t] = h
            both = [np.concatenate([states["f", t], states["b", t]]) for t in range(size)]
            e = np.exp([float((p["v"] @ np.tanh(p["a"] @ b))[0]) for b in both])
            pooled = sum(w * b for w, b in zip(e / e.sum(), both, strict=True))
            best = max(best, float((p["u"] @ pooled)[0] + p["c"][0]))
            if at + toxicity.WINDOW >= len(words):
                break
            at += toxicity.STRIDE
        assert score == pytest.approx(sigmoid(model.scale * best + model.shift), abs=1e-3)


def test_long_labelled_texts_are_trained_on_whole(spark, monkeypatch):
    docs, labels = labelled(spark, n=60)
    long = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.repeat("text", 500)).otherwise(F.col("text")))
    texts, found = labelled_rows.sample(long, labels, "toxic", 100)
    want = {r.text for r in long.collect() if r.doc_id % 5 == 0 and fold(r.doc_id) != 0}
    assert min(map(len, want)) > 0 and max(map(len, want)) > 20_000 and {t for t, y in zip(texts, found, strict=True) if y} == want
    assert toxicity.Model(texts, found).ready
    monkeypatch.setattr(labelled_rows, "TOTAL", 500_000)
    texts, found = labelled_rows.sample(long, labels, "toxic", 100)
    assert all(sum(len(t) for t, y in zip(texts, found, strict=True) if y == c) <= 500_000 for c in (0, 1)) and len(set(found)) == 2


def test_tiny_texts_and_training_without_words():
    model = toxicity.Model(["", "", "  "], [0, 1, 0])
    assert not model.ready and model.scores(pa.array(["a"])).tolist() == [0.0]
    model = toxicity.Model(["bad word", "good", "fine x"], [1, 0, 0])
    for texts in (["a"], ["", None], ["bad", "x y"]):
        assert all(0 <= x <= 1 for x in model.scores(pa.array(texts, pa.string())))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    x = rng.normal(size=(toxicity.WINDOW, toxicity.INPUTS, 3)).astype(np.float32)
    pad = np.zeros((toxicity.WINDOW, 3), bool)
    pad[20:, 1] = True
    gates = {d: lambda t, d=d: net.p[f"x{d}"] @ x[t] for d in "fb"}
    weight = np.array([1.0, -2.0, 0.5], np.float32)
    _, kept = net.logits(gates, pad, keep=True)
    slopes = net.gradients(weight, x, kept)
    for name, value in net.p.items():
        at = tuple(rng.integers(0, s) for s in value.shape)
        old = value[at]
        value[at] = old + 0.01
        up = float(net.logits(gates, pad) @ weight)
        value[at] = old - 0.01
        down = float(net.logits(gates, pad) @ weight)
        value[at] = old
        assert slopes[name][at] == pytest.approx((up - down) / 0.02, abs=0.02, rel=0.05), name


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def test_language_model_counts_and_beats_the_base(spark, small, monkeypatch):
    monkeypatch.setattr(language_model, "LISTED", 300)
    monkeypatch.setattr(language_model, "FREQUENT", 100)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "the the Qqq")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    text = {r.doc_id: tokens(r.text) for r in docs.collect()}
    count = Counter(w for i, ws in text.items() if fold(i) != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    got = language_model.scored(docs).collect()
    assert len(got) == len(text)
    for r in got:
        ws = text[r.doc_id]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id) == 1, len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.scored(docs.where("false")).count() == 0


def test_language_model_does_not_depend_on_which_rows_come_first(spark):
    rng = random.Random(3)
    kinds = [[f"{c}{i}word" for i in range(30)] for c in "ab"]
    rows = [(i, " ".join(rng.choice(kinds[i // 800]) for _ in range(20))) for i in range(1600)]
    one, other = ({r.doc_id: r.score for r in language_model.scored(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, rows[::-1]))
    assert all(one[i] == pytest.approx(other[i], rel=1e-6) for i in one)


def test_forward_equals_the_sum_over_all_state_paths():
    rng = np.random.default_rng(5)
    k, m = 3, 4
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    start, move, emit = norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0)
    first = np.array([0, 5, 6, 9])
    classes = rng.integers(0, m, 9)
    got = language_model.forward(classes, first, start, move, emit)
    starts, moves, emits = language_model.expected(classes, first, start, move, emit)
    assert starts.sum() == pytest.approx(3) and emits.sum() == pytest.approx(9) and moves.sum() == pytest.approx(6)
    for a, b, value in zip(first[:-1], first[1:], got, strict=True):
        c, total = classes[a:b], 0.0
        for path in np.ndindex(*[k] * len(c)):
            p = start[path[0]] * emit[c[0], path[0]]
            for t in range(1, len(c)):
                p *= move[path[t - 1], path[t]] * emit[c[t], path[t]]
            total += p
        assert value == pytest.approx(math.log10(total))
    # probabilities of all sequences of one length add up to 1
    every = np.array(list(np.ndindex(m, m, m))).ravel()
    assert (10 ** language_model.forward(every, np.arange(0, len(every) + 1, 3), start, move, emit)).sum() == pytest.approx(1)


def test_expected_counts_do_not_depend_on_the_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    k, m = 4, 30
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    model = norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0)
    first = np.concatenate([[0], np.cumsum([1, 700, 3, 60, 61, 2000, 1])])
    classes = rng.integers(0, m, first[-1])
    whole = language_model.gathered(classes, first, *model)
    assert whole[3] == pytest.approx(language_model.forward(classes, first, *model).sum())
    for rows in (7, 50, 333):
        monkeypatch.setattr(language_model, "ROWS", rows)
        for x, y in zip(whole, language_model.gathered(classes, first, *model), strict=True):
            assert np.allclose(x, y, rtol=1e-9)


@pytest.mark.parametrize(("long", "segment"), [(1, 1), (5, 3), (60, 7), (699, 250), (1000, 4096)])
def test_segments_of_long_texts_give_what_whole_texts_give(monkeypatch, long, segment):
    rng = np.random.default_rng(9)
    k, m = 4, 30
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    model = norm(rng.random(k), 0), norm(rng.random((k, k)) ** 4, 1), norm(rng.random((m, k)) ** 3, 0)
    first = np.concatenate([[0], np.cumsum([1, 700, 3, 60, 61, 2000, 1, 5])])
    classes = rng.integers(0, m, first[-1])
    counts, scores = language_model.gathered(classes, first, *model), language_model.forward(classes, first, *model)
    monkeypatch.setattr(language_model, "LONG", long)
    monkeypatch.setattr(language_model, "SEGMENT", segment)
    monkeypatch.setattr(language_model, "ROWS", 99)
    assert np.allclose(language_model.forward(classes, first, *model), scores, rtol=1e-10)
    for x, y in zip(counts, language_model.gathered(classes, first, *model), strict=True):
        assert np.allclose(x, y, rtol=1e-8)
    single = language_model.gathered(classes, first, *(x.astype(np.float32) for x in model))
    assert all(np.allclose(x, y, rtol=2e-3, atol=1e-3) for x, y in zip(counts, single, strict=True))


def test_language_model_of_long_null_repeated_and_clashing_rows(spark):
    rows = [(1, "a b " * 40_000), (2, None), (2, None), (None, "a zzz"), (3, "A b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "row": F.lit(1), "token": F.lit(2), "held_out": F.lit(0)})
    got = language_model.scored(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 80_001), ("2", 1), ("2", 1), ("3", 3), ("None", 3)]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert [language_model.buckets_for(n) for n in (0, 256_000, 300_000, 10**9)] == [64, 64, 128, 4096]


def test_features_do_not_depend_on_the_batch():
    texts = ["A b!! C", "", None, "x | y | z", "é " * 40]
    together = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], together[i])


def test_a_rest_of_texts_goes_with_the_lot_before_it(monkeypatch):
    monkeypatch.setattr(language_model, "TOKENS", 5)
    pairs = [(np.arange(n, dtype=np.int32), np.array([0, 1, n])) for n in (3, 4, 2, 5, 1, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array([x[i].tobytes() for x in pairs], pa.binary()) for i in (0, 1)], ["classes", "first"])
    lots = list(language_model._lots(iter([batch])))
    assert [f.tolist() for _, f in lots] == [[0, 1, 3, 4, 7], [0, 1, 2, 3, 7, 8, 8, 9, 10]]
    assert np.concatenate([c for c, _ in lots]).tolist() == np.concatenate([c for c, _ in pairs]).tolist()
    assert list(language_model._lots(iter([]))) == []


def test_classes_from_the_places_in_the_longer_list():
    h = np.random.default_rng(1).integers(1, 2**63, 400).astype(np.uint64)
    classes, tail = language_model.Classes(h[:50], 64), h[::-1] % np.uint64(1000)
    assert (classes.of(h, tail) == classes.among(language_model.Table(h[:200]).find(h), tail)).all()
