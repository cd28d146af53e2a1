"""Whitening of vectors, with the scatter of their integers counted bit by bit.

Components become integers. Each dimension's integers are shifted by their least
and cut into bit planes; a plane's bits of many rows lie side by side in words.
The sum of the products of two dimensions is then the sum, over pairs of their
planes, of the number of bits set in both, each times the planes' weights: words are
ANDed, bits counted, and nothing is rounded. Centring happens in integers too
(n times the scatter less the product of the sums), so the covariance is exact up
to its last division, whatever the number of rows and however far their mean lies
from zero. Its eigenvectors and eigenvalues, a matrix as wide as a vector, are
found on the driver; tasks send sums by pairs of dimensions only.

Defined cases: null vectors and those with null or non-finite components are left
out, as are those of another length than most; rows with equal or null ids are
vectors of their own; directions in which the vectors don't differ (an eigenvalue
of at most 1e-10 of the largest, as with a single vector or fewer vectors than
components) have no component; a component's sign makes its largest entry positive;
extra columns are ignored; an empty table gives an empty result. Scaled components
of 2**48 or more raise an error; a deviation that no 64-bit number holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.vectors import finite, usual_length

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK = 1 << 16  # rows whose bits are packed together
OUT = 4096  # rows whose components are given out together
LARGEST = 1 << 48  # of a scaled component
FLAT = 1e-10  # of the largest eigenvalue
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(batch: pa.RecordBatch, size: int) -> tuple[pa.RecordBatch, np.ndarray]:
    rows, x = finite(batch, size)
    x = np.floor(SCALE * x)
    if (np.abs(x) >= LARGEST).any():
        raise ValueError(f"components from {LARGEST // SCALE} on can't be whitened")
    return rows, x.astype(np.int64) + OFFSET


def _measured(size: int):
    """Number, sum, least and greatest integer of each dimension in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, np.zeros(size, object), None, None
        for b in batches:
            _, x = _integers(b, size)
            if len(x):
                n, total = n + len(x), total + x.sum(0).astype(object)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            columns = [pa.array(np.arange(size, dtype=np.int32)), pa.array([n] * size), pa.array(total.tolist(), pa.decimal128(38, 0)), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, ["at", "n", "total", "low", "high"])

    return run


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The ``bits[i]`` lowest bit planes of each column i of ``y``, packed across rows into words."""
    out = np.zeros((int(bits.sum()), -(-len(y) // 64) * 8), np.uint8)
    first = np.cumsum(bits) - bits
    for b in range(int(bits.max())):
        own = np.flatnonzero(bits > b)
        packed = np.packbits(((y[:, own] >> b) & 1).astype(np.uint8), axis=0).T
        out[first[own] + b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def shared_bits(words: np.ndarray) -> np.ndarray:
    """The number of rows in which both bits are set, for all pairs of planes."""
    out = np.zeros((len(words), len(words)), np.int64)
    for p in range(len(words)):
        out[p, p:] = out[p:, p] = np.bitwise_count(words[p] & words[p:]).sum(1, dtype=np.int64)
    return out


def weighted(counts: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Exact sums of products for all pairs of dimensions, from the counts of their planes."""
    weights = np.array([1 << b for n in bits for b in range(n)], object)
    first = np.cumsum(bits) - bits
    products = counts.astype(object) * weights[:, None] * weights[None]
    return np.add.reduceat(np.add.reduceat(products, first, axis=0), first, axis=1)


def _scatter(size: int, low: np.ndarray, bits: np.ndarray):
    """Sums of products of shifted integers in a task, by pairs of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, rows = np.zeros((int(bits.sum()),) * 2, np.int64), [], 0
        for b in batches:
            held.append(_integers(b, size)[1] - low)
            rows += len(held[-1])
            if rows >= BLOCK:
                counts += shared_bits(planes(np.concatenate(held), bits))
                held, rows = [], 0
        if rows:
            counts += shared_bits(planes(np.concatenate(held), bits))
        i, j = np.triu_indices(size)
        total = weighted(counts, bits)[i, j].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total, pa.decimal128(38, 0))], ["i", "j", "total"])

    return run


class Whitening(NamedTuple):
    """What turns integers into whitened components."""

    size: int
    n: int
    low: np.ndarray
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def components(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([(s - self.n * int(low)) / self.n for s, low in zip(self.sums, self.low, strict=True)])
        return ((x - self.low) - mean) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray, largest: int) -> list[int | None]:
        """Exact squared lengths of n * x - S; ``largest`` bounds |n * x - S| over all dimensions."""
        fits = largest * largest * self.size < 1 << 63
        apart = x.astype(np.int64 if fits else object) * self.n - np.array(self.sums, np.int64 if fits else object)
        found = (apart * apart).sum(1).tolist()
        return found if fits else [v if v < 1 << 63 else None for v in found]


def fit(vectors: DataFrame) -> tuple[Whitening | None, int]:
    """The whitening of all finite vectors of ``vectors`` (vec_id, embedding), and the bound of their deviations."""
    size = usual_length(vectors)
    if not size:
        return None, 0
    found = vectors.mapInArrow(_measured(size), "at int, n long, total decimal(38,0), low long, high long")
    by_at = found.groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    by_at = sorted(by_at.collect())
    if not by_at:
        return None, 0
    n, sums, low = by_at[0]["n"], [int(r["total"]) for r in by_at], np.array([r["low"] for r in by_at], np.int64)
    bits = np.array([max(1, (r["high"] - r["low"]).bit_length()) for r in by_at])
    found = vectors.mapInArrow(_scatter(size, low, bits), "i int, j int, total decimal(38,0)")
    covariance = np.zeros((size, size))
    shifted = [s - n * int(a) for s, a in zip(sums, low, strict=True)]
    for r in found.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        i, j = r["i"], r["j"]
        covariance[i, j] = covariance[j, i] = (n * int(r["total"]) - shifted[i] * shifted[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:COMPONENTS], axes[:, ::-1][:, :COMPONENTS]
    some = values > FLAT * max(values[0], 0)
    values, axes = values[some], axes[:, some]
    axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0) < 0, -1, 1)
    largest = max((r["high"] - r["low"]) * n for r in by_at)
    return Whitening(size, n, low, sums, axes, values, values / np.trace(covariance)), largest


def _products(w: Whitening):
    """Sums and sums of products of a task's whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        sums, products = np.zeros(k), np.zeros((k, k))
        for b in batches:
            z = w.components(_integers(b, w.size)[1])
            sums += z.sum(0)
            products += z.T @ z
        i, j = (v.ravel().astype(np.int32) for v in np.indices((k, k + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.c_[products, sums].ravel())], ["i", "j", "total"])

    return run


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity.

    Rows are centred before they are multiplied; what rounding leaves of their mean is taken off.
    """
    k = len(w.values)
    found = np.zeros((k, k + 1))
    for r in vectors.mapInArrow(_products(w), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        found[r["i"], r["j"]] = r["total"] / w.n
    return float(np.abs(found[:, :k] - np.outer(found[:, k], found[:, k]) - np.eye(k)).max(initial=0.0))


def _whitened(w: Whitening, largest: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for b in batches:
            rows, all_x = _integers(b, w.size)
            for a in range(0, len(all_x), OUT):
                x, ids = all_x[a : a + OUT], rows.column(0).slice(a, OUT).cast(pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), w.n)),
                    pa.array(w.deviations(x, largest), pa.int64()).take(each),
                    pa.array(w.components(x).ravel()),
                    pa.array(np.tile(w.explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened(vectors: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each vector and component."""
    vectors = vectors.select("vec_id", "embedding")
    w, largest = fit(vectors)
    if w is None:
        return vectors.sparkSession.createDataFrame([], COLUMNS)
    return vectors.mapInArrow(_whitened(w, largest, identity_error(vectors, w)), COLUMNS)
