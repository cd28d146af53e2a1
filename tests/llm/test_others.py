"""Fingerprints, URL filters, licenses, neighbours, pieces and the pipeline against plain versions."""

import hashlib
import math
import re
import time
import unicodedata
from collections import Counter
from fnmatch import translate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import fingerprints, licenses, neighbours, pieces, url_filters


def test_fingerprints_of_texts_and_edited_texts(spark, table):
    rows = [(5, "Ａ  b"), (2, "a B"), (9, "xyz" * 50), (7, None), (3, ""), (11, "ß" * 9), (12, "a\nb")]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(table(rows)).collect()}
    order = sorted(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        form = fingerprints.canonical
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.digest(form(text)) and r.edited_fingerprint == fingerprints.digest(form(edited))
        assert r.near_edited == float(form(edited) == form(text)) and r.near_next == float(form(after) == form(text))
    assert got[5].fingerprint == got[2].fingerprint == got[12].fingerprint != got[9].fingerprint


def plain_form(text):
    """The canonical form spelt out anew: NFKC around case folding, white space by a pattern."""
    low = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", low).strip()


def weak():
    """A digest of one bit; made inside a function, so that it travels to the workers by value."""
    return lambda form: ("even", "odd")[len(form) % 2]


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_colliding_digests_are_told_apart_by_their_bytes(spark, table, monkeypatch, few):
    monkeypatch.setattr(fingerprints, "FEW", few)
    monkeypatch.setattr(fingerprints, "FEW_DIGESTS", few)
    rows = [(i, t) for i, t in enumerate(["abcd", "ABCD ", "abce", "x", "abc", "", None, "ÀÈ", "abcd"])]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(table(rows), weak()).collect()}
    forms, prints = {}, {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after, half = text or "", after or "", len(text or "") // 2
        for form, mark in ((plain_form(text), got[i].fingerprint), (plain_form(text[: len(text) - half] + after[:half]), got[i].edited_fingerprint)):
            assert forms.setdefault(form, mark) == mark and prints.setdefault(mark, form) == form
    assert all("-" in mark for mark in prints)


def test_bytes_are_compared_inside_equal_buckets(spark, table):
    found = spark.createDataFrame([(1, "even"), (2, "even"), (3, "odd"), (4, "odd")], "doc_id long, fingerprint string")
    docs = table([(1, "ab"), (2, "cd"), (3, "a"), (4, "A")]).select("doc_id", "text")
    assert [r.found for r in fingerprints.shared_digests(docs, found, weak()).collect()] == ["even"]
    assert fingerprints.shared_digests(docs, found.withColumn("fingerprint", F.lit("same"))).count() == 0


def test_fingerprints_over_many_ranges_ties_and_long_texts(spark, table):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("aB  é\nＱ"), rng.integers(0, 40))) for _ in range(300)] + ["long " * 200_000]
    rows = [(int(i), t) for i, t in zip(rng.permutation(5000)[: len(texts)], texts, strict=True)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(table(rows).repartition(7)).collect()}
    order = sorted(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].near_next == float(plain_form(text) == plain_form(after))
    mark = {}
    assert all(mark.setdefault(plain_form(t), got[i].fingerprint) == got[i].fingerprint for i, t in rows) and len(set(mark.values())) == len(mark)
    twice = [tuple(r) for _ in range(2) for r in fingerprints.edited_fingerprints(table([(1, "ab"), (1, "cd"), (1, "ef"), (2, "gh")])).collect()]
    assert len(twice) == 8 and sorted(twice[:4]) == sorted(twice[4:])


def test_fingerprints_of_one_and_no_document(spark, table):
    one = fingerprints.edited_fingerprints(table([(1, "abcd")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.edited_fingerprints(table([(1, "abcd")]).where("false")).count() == 0
    assert fingerprints.edited_fingerprints(table([(1, "x"), (1, "x"), (None, "y")])).count() == 3


def test_automaton_against_regular_expressions():
    rng = np.random.default_rng(3)
    letters = np.array(list("ab/."))
    globs = ["".join(rng.choice(np.array(list("ab/.*")), rng.integers(1, 30))) for _ in range(60)] + ["**", "*", "a**b", ""]
    machine = url_filters.Automaton(globs)
    texts = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(300)]
    fit = machine.fits([t.encode() for t in texts])
    for k, g in enumerate(globs):
        parts = re.split(r"(\*+)", g)
        # each pair of stars is wide, a single one that is left over is not
        rx = "".join(".*" if "**" in p else "[^/]*" if p == "*" else re.escape(p) for p in parts)
        for t, got in zip(texts, fit[:, k], strict=True):
            assert got == bool(re.fullmatch(rx, t, re.S)), (g, t)
    assert translate("*")


def test_url_rules(spark):
    urls = ["http://Example.com/en/x", "https://www.example.com/en/", "x://a.net/es/1?q", "y://net/fr", "no scheme", None, "h://com", "h://b.com/", "h://notcom/", "h://x.org/a.exe", "h://" + "a" * 5000 + ".com/" + "b" * 9000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judged(df).collect()}
    want = [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), (None, "allow"), (None, "block"), ("com/", "allow")]
    assert got == dict(enumerate(want))


def test_templates():
    accepts = lambda wording, text: licenses.Template(wording).accepts(text.encode().split(), 0)
    assert accepts("a [b c] d", "a d x") and accepts("a [b c] d", "a b c d") and not accepts("a [b c] d", "a b d")
    assert accepts("a {2} d", "a d") and accepts("a {2} d", "a x y d") and not accepts("a {2} d", "a x y z d")
    assert accepts("a [b {1} c] d [e]", "a b q c d") and not accepts("a b", "a")


def test_templates_that_begin_or_end_with_markup():
    ends = lambda wording, text, at=0: licenses.Template(wording).end(text.encode().split(), at)
    assert ends("[the] mit license", "the mit license") == 3 and ends("[the] mit license", "mit license") == 2
    assert ends("{2} mit [license]", "mit license x") == 2 and ends("{2} mit", "a b mit") == 3 and ends("a [b]", "a c") == 1
    assert licenses.Template("{2} [x y] mit").heads == {b"x", b"mit"}
    with pytest.raises(ValueError):
        licenses.Template("[only optional]")


def test_many_hits_in_a_long_text_take_time_in_proportion_to_it():
    scan = licenses.Scanner(licenses.TEMPLATES).scan
    seconds = []
    for n in (100_000, 800_000):
        began = time.process_time()
        assert scan(b"mit license " * n)[:4] == (2 * n, n, 0, 2 * n - 2)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 24 * seconds[0] + 1  # eight times the text; counting from its begin took sixty-four times as long


def test_templates_against_regular_expressions():
    from palisade.llm.oracles import _regex

    rng = np.random.default_rng(6)
    for wording in ("a [b c] {2} d", "[a] b [c {1}] d", "{1} a b", "a [b] [c] a {3} b", "a [b {2} c] d [e]"):
        template, rx = licenses.Template(wording), re.compile(_regex(wording))
        for _ in range(300):
            words = rng.choice(list("abcde"), rng.integers(0, 9)).tolist()
            coded = [w.encode() for w in words]
            got = any(template.accepts(coded, i) for i in range(len(words)) if coded[i] in template.heads)
            assert got == bool(rx.search(" " + " ".join(words) + " ")), (wording, words)


MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_license_texts(spark, table):
    rows = [(1, "x = 1\n" + MIT + "\nmore"), (2, MIT.replace("substantial", "essential")), (3, MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME")), (3, MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME"))]
    got = {r.doc_id: r for r in licenses.scanned(table(rows)).collect()}
    assert got[1].labels == got[3].labels == "mit-text,mit-whole" and got[2].labels == "mit-text"
    span = {s.label: (s.first, s.stop) for s in got[1].spans}["mit-whole"]
    assert span == (7, got[1].n_words - 1)
    assert licenses.scanned(table(rows).where("false")).count() == 0


def test_license_rows(spark, table):
    rows = [(1, "x Released under the MIT License."), (2, "mit-license, MIT license"), (3, None), (4, ""), (5, "w " * 20_000 + "General Public License"), (6, "released under mit license")]
    got = {r.doc_id: tuple(r)[1:8] for r in licenses.scanned(table(rows)).collect()}
    assert got[1] == (6, 1, 4, 4, "mit", "mit,mit-notice", 1.0)
    assert got[2] == (4, 2, 0, 2, "mit", "mit", 0.5)
    assert got[3] == got[4] == (0, 0, None, None, "", "", 0.0)
    assert got[5] == (20_003, 1, 20_000, 20_000, "gpl", "gpl", 0.5)
    assert got[6][4:] == ("mit", "mit", 0.5)


def test_license_templates_of_any_wording(spark, table):
    own = (("reserved", "all rights [are] reserved"), ("public", "in the public {1} domain"))
    rows = [(1, "All Rights Reserved"), (2, "it is in the public world domain"), (3, "rights reserved")]
    assert {r.doc_id: (r.labels, r.score) for r in licenses.scanned(table(rows), own).collect()} == {1: ("reserved", 1.0), 2: ("public", 1.0), 3: ("", 0.0)}


def test_neighbours_reach_recall_and_break_ties(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    odd = spark.createDataFrame([(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, [1.0], 1), (None, [1.0] * 64, 1), *[(9100 + i, [0.125] * 64, 1) for i in range(40)]], "vec_id long, embedding array<float>, label int")
    both = vectors.unionByName(odd)
    rows = [(r.vec_id, np.array(r.embedding, np.float64)) for r in both.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and all(map(math.isfinite, r.embedding)) and any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in neighbours.nearest(both, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        found = sorted(got[q])
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit, total = hit + len({ids[k] for k in order} & {f[1] for f in found}), total + 20
    assert set(got) == set(ids[ids % 20 == 0].tolist()) and hit >= 0.9 * total
    assert [f[1] for f in sorted(got[9100])] == list(range(9101, 9121))
    assert neighbours.nearest(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_groups_of_copies_and_single_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 5)
    rng = np.random.default_rng(4)
    groups = np.repeat(rng.normal(size=(40, 16)), 50, axis=0)
    x = np.concatenate([groups, rng.normal(size=(20, 16))])
    x[:2000, 8:], x[2000:, :8] = 0, 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2015, x[2015].tolist())] * 30
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0).groupBy("query_id").count().collect()
    assert len(got) == 404 and {r["count"] for r in got if r.query_id != 2015} == {20} and [r["count"] for r in got if r.query_id == 2015] == [20]


def written(spark):
    """Bytes that the session has shuffled so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_queries_go_to_groups_and_not_to_every_leaf_they_visit(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 4)
    x = np.random.default_rng(6).normal(size=(6000, 32)).round(3)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4).cache()
    before, kept = table.count() and written(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        first = neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(first) == 6000 and written(spark) - before < 10_000_000
    monkeypatch.setattr(neighbours, "GROUPS", 3)
    monkeypatch.setattr(neighbours, "GROUP", 130)
    assert sorted(neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect()) == sorted(first)


def test_walks_of_many_queries_equal_those_of_the_queue():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1500, 8)), rng.normal(3, 0.1, size=(300, 8))])
    tree, q = neighbours.Tree(x, 250), np.concatenate([rng.normal(size=(300, 8)), x[:40]])
    for most in (1, 2, 9, 60, tree.leaves - 1, tree.leaves):
        seen = neighbours.Walks(tree, 8).seen(q, most)
        assert [set(np.flatnonzero(s).tolist()) for s in seen] == [set(tree.visits(v, most)) for v in q]
    alone = neighbours.Tree(np.zeros((0, 8)), 1)
    assert neighbours.Walks(alone, 8).seen(q, 1).all() and alone.visits(q[0], 1) == [0]
    copies = neighbours.Tree(np.repeat(rng.normal(size=(30, 8)), 20, axis=0), 60)  # centres of equal promise, in any order
    assert all((neighbours.Walks(copies, 8).seen(q, most).sum(1) == most).all() for most in (1, 9, copies.leaves))


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary()


def test_pieces_are_lossless_and_repeatable(spark, table):
    texts = ["hello world", "", None, "  a  b\n\nc\t", "naïve café ▁ 漢字 😀", " ", "x" * 3000, "▁", "é" * 700, "\n" * 5]
    docs = table([(i, t) for i, t in enumerate(texts)] + [(0, "hello world"), (None, "a b")])
    rows = pieces.encoded(docs)
    got = rows.collect()
    assert all(r.lossless for r in got) and sorted(map(str, got)) == sorted(map(str, pieces.encoded(docs).collect()))
    back = {r.doc_id: r.text for r in pieces.decoded(rows).collect() if r.doc_id is not None}
    assert [back[i] for i in range(len(texts))] == texts
    assert {r.doc_id: r.n_pieces for r in got}[1] == 0
    assert pieces.encoded(docs.where("false")).count() == 0


def test_pieces_have_the_lattice_distribution(vocabulary):
    v, raw = vocabulary, b" tests"

    def paths(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if (i := v.found.get(s[:n])) is not None:
                for rest, log in paths(s[n:]):
                    yield (i, *rest), log + v.log[i]

    every = dict(paths(raw))
    whole, n = sum(map(math.exp, every.values())), 20_000
    flat, at = pieces.encode(pa.array(["tests"] * n), np.arange(n).astype(np.uint64), v, 1)
    count = Counter(tuple(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
    assert set(count) <= set(every)
    assert all(abs(count[p] / n - math.exp(log) / whole) < 0.015 for p, log in every.items())


def test_long_units_by_blocks(vocabulary, monkeypatch):
    v, text = vocabulary, " " + "".join(np.random.default_rng(2).choice(list("abcdefghij"), 2000))
    data, drawn = np.frombuffer(text.encode(), np.uint8), []
    for block in (1 << 15, 100, 7):
        monkeypatch.setattr(pieces, "BLOCK", block)
        drawn.append(pieces.draw_long(data, 5, v).tolist())
    assert drawn[0] == drawn[1] == drawn[2] and b"".join(v.text[i] for i in drawn[0]) == text.encode()
    raw, count, n = np.frombuffer(b" test", np.uint8), Counter(), 4000
    for k in np.random.default_rng(1).integers(0, 1 << 62, n).tolist():
        count[tuple(pieces.draw_long(raw, k, v).tolist())] += 1
    short = Counter(tuple(f.tolist()) for f in (pieces.encode(pa.array(["test"]), np.array([k], np.uint64), v, 1)[0] for k in range(n)))
    assert all(abs(count[p] - short[p]) < 5 * math.sqrt(n) for p in set(count) | set(short))


def test_a_line_of_half_a_megabyte_without_spaces(spark, table):
    line = "".join(np.random.default_rng(4).choice(list("ACGTé漢"), 200_000))
    got = pieces.encoded(table([(1, line), (2, line + "\n" + line)])).collect()
    assert all(r.lossless for r in got) and [r.n_bytes for r in got] == [len(line.encode()), 2 * len(line.encode()) + 1]


def test_empty_tables_repeated_rows_and_clashing_columns(spark, table):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None)], "page_id long, url string").withColumns({"rule": F.lit(1), "verdict": F.lit("x"), "path": F.lit(2)})
    assert sorted((str(r.page_id), r.host, r.verdict) for r in url_filters.judged(pages).collect()) == [("1", "a.com", "allow"), ("1", "a.com", "allow"), ("None", "", "allow")]
    assert url_filters.judged(pages.where("false")).count() == 0
    docs = table([(1, "MIT license"), (1, "MIT license"), (None, None)]).withColumns({"labels": F.lit(1), "n_words": F.lit("x"), "spans": F.lit(0)})
    rows = licenses.scanned(docs).collect()
    assert len(rows) == 3 and sum(r.labels == "mit" for r in rows) == 2 and licenses.scanned(docs.where("false")).count() == 0
    wide = docs.withColumns({"pieces": F.lit(1), "lossless": F.lit("x"), "fingerprint": F.lit(1), "part": F.lit(0), "tail": F.lit(1)})
    assert pieces.encoded(wide).count() == 3 and fingerprints.edited_fingerprints(wide).count() == 3
    vectors = [(i, [float(i % 7 + 1), 1.0, float(i)]) for i in range(60)] + [(20, [1.0, 2.0, 3.0]), (20, [3.0, 1.0, 0.5])]
    odd = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit("x"), "leaf": F.lit(0)})
    found = neighbours.nearest(odd, F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and {r.query_id for r in found.collect()} == {0, 20, 40}


def test_pipeline_against_plain_stages(spark, small):
    """Each stage's rows from its operator's scores, links and counts, one document at a time."""
    import corpus_pipeline
    from palisade.llm import mixing, quality, toxicity

    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(200)
    rows = {r.doc_id: r for r in docs.collect()}
    clean, good, distinct, mix = (stage for _, stage in corpus_pipeline.STAGES[:-1])

    def table(ids):
        return spark.createDataFrame([rows[i] for i in sorted(ids)], docs.schema)

    model = toxicity.fit(docs, labels)
    kept = {i for i, r in rows.items() if model.scores(pa.array([r.text]))[0] < 0.5}
    assert {r.doc_id for r in clean(spark, docs, small).collect()} == kept
    ranking = quality.fit(table(kept), labels)
    better = {i for i in kept if ranking.scores(pa.array([rows[i].text]))[0] >= quality.CUT}
    assert {r.doc_id for r in good(spark, table(kept), small).collect()} == better
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i in better:
        w = re.findall(r"[^\x20\x09-\x0D]+", (rows[i].text or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in better}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(better):
        for b in sorted(better):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    single = {i for i in better if find(i) == i}
    assert {r.doc_id for r in distinct(spark, table(better), small).collect()} == single < better
    times = {r.doc_id: r.times for r in mixing.plan(table(single)).collect()}
    mixed = mix(spark, table(single), small)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n}) and max(times.values()) <= 2
    for stage in (clean, good, distinct, mix):
        assert stage(spark, docs.where("false"), small).count() == 0


def test_pipeline_stages_take_effect(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    made = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert len(made) == docs.count() > 0 and all(r.lossless for r in made)


def test_pipeline_with_nulls_repeated_rows_and_clashing_columns(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    first = docs.orderBy("doc_id").first()
    odd = spark.createDataFrame([(None, first["text"], "en", None, 1), (None, None, None, "s", None), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), tuple(first)], docs.schema)
    own = ["2 AS n", "'x' AS score", "7 AS size", "1.5D AS target", "array(1) AS times", "true AS component_id", "'k' AS key", "'r' AS rep"]
    wide = docs.unionByName(odd).selectExpr(*own[:3], "text", "doc_id", *own[3:], "lang", "source", "n_chars")
    before, now = wide.count(), wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, small)
        assert after.schema.simpleString() == wide.schema.simpleString(), name
        if name != "source mixing":
            assert after.count() <= before
        if name == "toxicity":
            assert after.where("doc_id IS NULL").count() == 2 and after.where("text IS NULL").count() == 2  # nothing in them is toxic
        if name == "n-gram Jaccard join":
            kept = {r[0] for r in after.where("doc_id IS NOT NULL").select("doc_id").collect()}
            assert kept <= {r[0] for r in now.select("doc_id").collect()}
            assert after.where("doc_id IS NULL").count() == now.where("doc_id IS NULL").count()
        before, now = after.count(), spark.createDataFrame(after.collect(), wide.schema)
    made = corpus_pipeline.STAGES[-1][1](spark, now, small)
    assert made.columns == ["doc_id", "n_bytes", "n_pieces", "pieces", "lossless"] and made.count() == now.count() and made.where("NOT lossless").count() == 0
