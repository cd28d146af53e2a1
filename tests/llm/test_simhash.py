"""SimHash links and components against all pairs."""

import random
import re

import pytest
import xxhash

from palisade.llm import queries, simhash
from palisade.llm.components import components
from palisade.llm.store import Stages


def plain_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least key that each key of ``prints`` (key to fingerprint) reaches."""
    of, items = {k: k for k in prints}, sorted(prints.items())

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                of[high] = low
    return {k: root(k) for k in prints}


def unsigned(x):
    return x & (1 << 64) - 1


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_fingerprints_are_the_majority_of_hashes(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    texts = ["", " \t\n", "One", "one TWO", "a b c", "É é\x0bß x  y z", "A b c A b c A b c"]
    texts += [" ".join(rng.choice("red Green blüe x".split()) for _ in range(rng.randrange(400))) for _ in range(20)]
    assert [unsigned(simhash.fingerprint(t.encode())) for t in texts] == [plain_print(t) for t in texts]


@pytest.mark.parametrize("limit", [1, 4, 16])
def test_links_join_what_all_pairs_join(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(40):  # chains of steps of one to three bits, many with an equal half
            y = x
            for _ in range(rng.choice((1, 2, 2, 3))):
                y ^= 1 << rng.randrange(rng.choice((32, 64)))
            prints.add(y)
            x = y if rng.random() < 0.6 else x
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    stages = Stages(spark, "test-simhash")
    links = stages.keep(simhash.links(spark.createDataFrame([(x,) for x in signed], "print long"), stages))
    assert all((unsigned(r["a"]) ^ unsigned(r["b"])).bit_count() <= 2 for r in links.collect())
    found = {r["node"]: r["component"] for r in components(links, stages).collect()}
    expected = plain_components({x: unsigned(x) for x in signed})
    assert {x: found.get(x, x) for x in signed} == expected


def test_more_fingerprints_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FEW", 0)
    prints = [(1 << i) | (1 << j) for i in range(0, 60, 3) for j in range(1, 60, 4)]
    stages = Stages(spark, "test-simhash")
    links = simhash.links(spark.createDataFrame([(x,) for x in set(prints)], "print long"), stages)
    found = {r["node"]: r["component"] for r in components(links, stages).collect()}
    assert {x: found.get(x, x) for x in prints} == plain_components({x: x for x in prints})


def test_nulls_copies_and_other_columns(spark, table):
    text = "the quick brown fox jumps over the lazy dog and runs home again"
    rows = [(5, text), (9, text.upper()), (7, None), (4, " \n"), (None, text), (11, "two words"), (11, "two  WORDS"), (12, text), (12, text)]
    found = sorted((tuple(r) for r in simhash.grouped(table(rows)).collect()), key=str)
    expected = plain_components({str(i).zfill(2): plain_print(t) for i, (k, t) in enumerate(rows) if k is not None})
    least = {}
    for i, of in expected.items():
        least[of] = min(least.get(of, 99), rows[int(i)][0])
    wanted = [(k, f"{plain_print(t):016x}", None if k is None else least[expected[str(i).zfill(2)]]) for i, (k, t) in enumerate(rows)]
    assert found == sorted(wanted, key=str)
    assert simhash.grouped(table([])).collect() == []


def test_query_over_the_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_print(r["text"]) for r in docs}
    least = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op11_simhash_variants"](spark, small).collect()}
    assert got == {k: (f"{x:016x}", least[k]) for k, x in prints.items()}
