"""Vector codes and whitening against plain computations."""

import math

import numpy as np
import pytest

from palisade.llm import compression, queries, whitening


def vectors(spark, rows):
    """A table of (vec_id, embedding, label) rows, with other columns of names that the operators use."""
    kind = "vec_id long, embedding array<float>, label int, error string, n int"
    return spark.createDataFrame([(*r, "x", 1) for r in rows], kind)


def odd_rows(seed=1, n=300, size=16):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, n)), rng.normal(0, 0.2, size).round(2).tolist(), int(rng.integers(0, 3))) for _ in range(n)]
    rows += [(7, rows[0][1], None), (None, [0.5] * size, None), (None, [0.25] * size, 1), *[(1000 + i, [-0.1] * size, 2) for i in range(200)]]
    return rows + [(1, None, 1), (2, [math.nan] * size, 1), (3, [None, *[0.0] * (size - 1)], 2), (4, [math.inf, *[0.0] * (size - 1)], 0), (5, [1.0], 0), (6, [], 0)]


def usable(rows, size=16):
    return [r for r in rows if r[1] and len(r[1]) == size and all(v is not None and math.isfinite(v) for v in r[1])]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = usable(rows)
    x = np.floor(4096 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:entries]
    cut = x.reshape(len(x), parts, -1)
    books = cut[first].transpose(1, 0, 2).copy()
    for i in range(rounds + 1):
        apart = ((cut[:, :, None] - books[None]) ** 2).sum(-1)
        near = apart.argmin(-1)
        if i < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    if (near[:, p] == e).any():
                        books[p, e] = cut[near[:, p] == e, p].sum(0) // (near[:, p] == e).sum()
    return rows, near, apart.min(-1).sum(-1), books


def test_codes_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(compression, "BLOCK", 150)  # several blocks
    rows = odd_rows()
    used, near, error, books = plain_codes(rows)
    by_label = {label: int(sum(e for r, e in zip(used, error, strict=True) if r[2] == label)) for label in {r[2] for r in used}}
    wanted = [(r[0], bytes(c.astype(np.uint8)).hex(), int(e), by_label[r[2]], compression.digest(books)) for r, c, e in zip(used, near, error, strict=True)]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in compression.compressed(vectors(spark, rows)).collect())


@pytest.mark.parametrize("n", [1, 5])
def test_fewer_vectors_than_entries(spark, n):
    rows = [(i, [i / 4] * 16, i) for i in range(n)]
    found = sorted(tuple(r)[:4] for r in compression.compressed(vectors(spark, rows)).collect())
    assert found == [(i, f"{i:02x}" * 8, 0, 0) for i in range(n)]


def test_lengths_that_are_no_multiple_and_large_components(spark):
    found = compression.compressed(vectors(spark, [(1, [0.5] * 11, 0), (2, [0.25] * 11, 0)])).collect()
    assert sorted(r["code"] for r in found) == ["00" * 8, "01" * 6 + "00" * 2]
    with pytest.raises(Exception, match="can't be compressed"):
        compression.compressed(vectors(spark, [(1, [1e6] * 16, 0)])).collect()


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [math.nan] * 16, 1)]):
        assert compression.compressed(vectors(spark, rows)).collect() == []
        assert whitening.whitened(vectors(spark, rows)).collect() == []


def test_whole_nodes_are_assigned_and_leaves_compared():
    """The walk settles copies and clusters by their boxes alone, and gives what all distances give."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, (6, 8))
    x = np.concatenate([c + rng.integers(-20, 20, (100, 8)) for c in centres] + [np.repeat(centres[:1], 300, axis=0), rng.integers(-3000, 3000, (50, 8))])
    entries = np.concatenate([centres + rng.integers(-5, 5, centres.shape), rng.integers(-3000, 3000, (9, 8))])
    s = compression.shape(len(x), compression.LEAF)
    t = compression.tree(x, compression.order_of(x, s), s)
    near = ((x[:, None] - entries) ** 2).sum(-1).argmin(1)
    assert (compression.assigned(t, entries) == near).all()
    n, sums = compression.counted(t, entries)
    assert (n == np.bincount(near, minlength=len(entries))).all()
    assert all((sums[e] == x[near == e].sum(0)).all() for e in range(len(entries)))
    nodes, _, places, _ = compression.walk(t, entries)
    assert len(places) < 0.6 * len(x) and (t.shape.child[nodes] >= 0).any()


def test_ties_go_to_the_lower_entry():
    x = np.array([[0, 0], [2, 0], [1, 0], [5, 5]])
    s = compression.shape(4, 2)
    t = compression.tree(x, compression.order_of(x, s), s)
    assert compression.assigned(t, np.array([[2, 0], [0, 0], [2, 0], [0, 0]])).tolist() == [1, 0, 0, 0]


def plain_whitening(rows, components=32):
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:components], axes[:, ::-1][:, :components]
    return ((n * x - s) ** 2).sum(1), centred @ axes, e, e / np.trace(v)


def test_whitening_equals_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 100)
    monkeypatch.setattr(whitening, "OUT", 64)
    rows = [(i, *r[1:]) for i, r in enumerate(odd_rows(n=400))]
    found = whitening.whitened(vectors(spark, rows)).toPandas().sort_values(["vec_id", "component"])
    used = usable(rows)
    deviation, projected, e, explained = plain_whitening(used)
    assert found["component"].tolist() == list(range(1, 17)) * len(used)
    assert (found["n"] == len(used)).all()
    assert found["deviation"].tolist() == np.repeat(deviation, 16).tolist()
    assert np.allclose(np.abs(found["whitened"].to_numpy().reshape(-1, 16)), np.abs(projected / np.sqrt(e)), atol=1e-8)
    assert np.allclose(found["explained"].to_numpy().reshape(-1, 16), explained, rtol=1e-10)
    z = found["whitened"].to_numpy().reshape(-1, 16)
    z = z - z.mean(0)
    assert abs(np.abs(z.T @ z / len(z) - np.eye(16)).max() - found["identity_error"].iloc[0]) < 1e-12 and found["identity_error"].max() < 1e-9


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(4)
    y = np.stack([rng.integers(0, 1 << b, 1000) for b in (1, 7, 40, 3)] + [np.zeros(1000, np.int64)], 1)
    bits = np.array([max(1, int(c.max()).bit_length()) for c in y.T])
    found = whitening.weighted(whitening.shared_bits(whitening.planes(y, bits)), bits)
    exact = y.astype(object)
    assert (found == exact.T @ exact).all()


def test_directions_without_a_difference_have_no_component(spark):
    assert whitening.whitened(vectors(spark, [(1, [0.5] * 4, 0)] * 3)).collect() == []
    rows = [(i, [float(i), 2.0 * i, 0.5, 0.0], 0) for i in range(10)]
    found = whitening.whitened(vectors(spark, rows)).toPandas()
    assert found["component"].unique().tolist() == [1] and abs(found["whitened"].var(ddof=0) - 1) < 1e-12 and found["explained"].iloc[0] == pytest.approx(1)


def test_deviations_beyond_a_long_are_null():
    w = whitening.Whitening(2, 1 << 33, np.zeros(2, np.int64), [0, 0], np.eye(2), np.ones(2), np.ones(2))
    assert w.deviations(np.array([[1, 0], [0, 1 << 20]]), 1 << 53) == [None, None]
    w = w._replace(n=1 << 20)
    assert w.deviations(np.array([[1, 0], [0, 1 << 20]]), 1 << 40) == [1 << 40, None]


def test_whitening_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = sorted(tuple(r) for r in rows)
    found = queries.QUERIES["op13_embedding_whitening"](spark, small).toPandas().sort_values(["vec_id", "component"])
    deviation, projected, e, explained = plain_whitening(rows)
    assert found["vec_id"].tolist() == np.repeat([r[0] for r in rows], 32).tolist()
    assert found["deviation"].tolist() == np.repeat(deviation, 32).tolist()
    assert np.allclose(np.abs(found["whitened"].to_numpy().reshape(-1, 32)), np.abs(projected / np.sqrt(e)), atol=1e-8)
    assert np.allclose(found["explained"].to_numpy().reshape(-1, 32), explained, rtol=1e-9)
