import random
import re

import pytest

from palisade.llm import ngram_join, words
from palisade.llm.components import components
from palisade.llm.store import Stages

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_force(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited_copies(seed):
    """Families of copies with a few words changed, texts that share a passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(3):
        base = [word() for _ in range(rng.randint(40, 160))]
        for k in range(12):
            w = list(base)
            for _ in range(k // 3):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w).upper() if k == 1 else " ".join(w))
    rows += [" ".join([word() for _ in range(30)] + passage) for _ in range(30)]
    rows += ["a b c", "A  b\tc", "a b", "", None, "x", "a b c d"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_match_all_pairs(spark, table, monkeypatch, n, percent):
    monkeypatch.setattr(ngram_join, "HOT", 5)
    rows = edited_copies(n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.grouped(table(rows), n, percent).collect()}
    assert got == brute_force(rows, n, percent)


def test_large_groups_of_copies_match_all_pairs(spark, table, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 2)
    rows = edited_copies(9) + [(1000 + i, "the same eight words stand in each text") for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.grouped(table(rows)).collect()}
    assert got == brute_force(rows, 4, 85)


def test_one_document_of_each_component_stays(spark, table):
    rows = [(3, "a b c d e f"), (1, "A B c d e f"), (2, "a b c d e x"), (4, None)]
    assert {r.doc_id for r in ngram_join.one_of_each(table(rows)).collect()} == {1, 2, 4}


def test_nulls_repeats_and_empty_tables(spark, table):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None), (3, "q " * 3000)]
    got = sorted([tuple(r) for r in ngram_join.grouped(table(rows)).collect()], key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2), (3, 1, 3)], key=str)
    assert ngram_join.grouped(table(rows).where("false")).count() == 0


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101 + i) for i in range(9)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Stages(spark, "test")).collect()}
    want = {i: 0 for i in range(1, 21)} | {i: 100 for i in range(101, 110)} | {i: 200 for i in range(201, 207)}
    assert {i: c for i, c in got.items() if i != c} == want


def test_long_words_and_batches_hash_alike():
    import pyarrow as pa

    long = "x" * (words.BLOCK + 5)
    w = words.words(pa.array([long, "a " + long, "b"]))
    h = words.hashes(w)
    assert h[0] == h[2] and len(set(h.tolist())) == 3
