"""Codes of vectors by parts, with codebooks from dual-tree Lloyd rounds in integers.

Vectors become integers and are cut into equal parts; each part's place has a
codebook of its own. Vectors lie in blocks, and each block holds, for each part's
place, a tree over its parts: the parts in the tree's order, and for each node the
box around its parts and their sum. Trees are built once and read in every round.

A round grows a tree over the entries of each codebook as well and walks both trees
together. Boxes give the least and the greatest distance between a node of parts
and a node of entries; a pair whose least distance exceeds another's greatest is
pruned. Where one entry is left, the whole node is assigned through its count and
its cached sum; leaves that keep several entries compare integer distances.
A block's counts and sums are the only things that leave it, so a round sends a
few numbers for each entry and task, whatever the number of vectors.

Defined cases: null vectors and those with null or non-finite components are left
out, as are those of another length than most; a length that is no multiple of the
number of parts is filled up with zeros; with fewer vectors than entries, codebooks
have an entry for each; rows with equal or null ids are vectors of their own, null
ids last where the first entries are chosen, ties by the vector; a null label is a
label; extra columns are ignored; an empty table gives an empty result. Components
of 32,768 or more raise an error, as squared distances have to fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.groups import onto_rows
from palisade.llm.store import Stages
from palisade.llm.vectors import finite, usual_length

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 2048  # vectors of a block
LEAF = 32  # parts of a leaf at most
LARGEST = 1 << 27  # of an integer component


class Shape(NamedTuple):
    """A balanced binary tree over places 0..n-1; ``child`` has a node's first child, the second follows it; -1 in leaves."""

    start: np.ndarray
    end: np.ndarray
    child: np.ndarray


def shape(n: int, leaf: int) -> Shape:
    spans, child = [(0, n)], []
    for a, b in spans:  # grows while it is read
        child.append(len(spans) if b - a > leaf else -1)
        if b - a > leaf:
            spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
    start, end = np.array(spans).T
    return Shape(start, end, np.array(child))


class Tree(NamedTuple):
    """Points in the order of a tree, and for each node its box and its points' sum."""

    shape: Shape
    order: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def order_of(x: np.ndarray, s: Shape) -> np.ndarray:
    """The rows of ``x`` in the order of a tree that halves each node across its widest side."""
    order = np.arange(len(x))
    for a, b in zip(s.start[s.child >= 0], s.end[s.child >= 0], strict=True):
        own = x[order[a:b]]
        side = (own.max(0) - own.min(0)).argmax()
        order[a:b] = order[a:b][np.argpartition(own[:, side], (b - a) // 2)]
    return order


def tree(x: np.ndarray, order: np.ndarray, s: Shape) -> Tree:
    points = x[order]
    ends = np.stack([s.start, s.end], 1).ravel()
    padded = np.concatenate([points, points[-1:]])
    low, high = (f.reduceat(padded, ends, axis=0)[::2] for f in (np.minimum, np.maximum))
    sums = np.zeros((len(x) + 1, x.shape[1]), np.int64)
    np.cumsum(points, axis=0, out=sums[1:])
    return Tree(s, order, points, low, high, sums[s.end] - sums[s.start])


def _groups(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs of equal values."""
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return first, np.diff(np.r_[first, len(p)])


def walk(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes assigned whole and their entries; places of points of uncertain leaves and their entries."""
    s = shape(len(entries), 1)
    e_tree = tree(entries, order_of(entries, s), s)
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole, chosen, leaves, entry = [], [], [], []
    while len(p):
        gap = np.maximum(0, np.maximum(t.low[p] - e_tree.high[e], e_tree.low[e] - t.high[p]))
        far = np.maximum(t.high[p] - e_tree.low[e], e_tree.high[e] - t.low[p])
        first, size = _groups(p)
        best = np.minimum.reduceat((far * far).sum(1), first)
        kept = (gap * gap).sum(1) <= np.repeat(best, size)
        p, e = p[kept], e[kept]
        first, size = _groups(p)
        e_leaf, p_leaf = s.child[e] < 0, t.shape.child[p] < 0
        all_leaves = np.repeat(np.logical_and.reduceat(e_leaf, first), size)
        one = np.repeat(size == 1, size) & e_leaf
        whole.append(p[one])
        chosen.append(e_tree.order[s.start[e[one]]])
        rest = ~one & all_leaves & p_leaf
        leaves.append(p[rest])
        entry.append(e_tree.order[s.start[e[rest]]])
        on = ~one & ~rest
        p, e, p_leaf, e_leaf = p[on], e[on], p_leaf[on], e_leaf[on]
        pairs = [
            (np.where(p_leaf, p, t.shape.child[p] + i), np.where(e_leaf, e, s.child[e] + j), ~(p_leaf & (i == 1)) & ~(e_leaf & (j == 1)))
            for i in (0, 1)
            for j in (0, 1)
        ]
        p, e = (np.concatenate([x[k][x[2]] for x in pairs]) for k in (0, 1))
        order = np.argsort(p, kind="stable")
        p, e = p[order], e[order]
    leaf, at = np.concatenate(leaves), np.concatenate(entry)
    nodes, of = np.unique(leaf, return_inverse=True)
    near = np.full((len(nodes), len(entries)), False)
    near[of, at] = True
    held = t.shape.end[nodes] - t.shape.start[nodes]
    places = np.repeat(t.shape.start[nodes] - np.cumsum(held) + held, held) + np.arange(held.sum())
    apart = t.points[places][:, None, :] - entries[None]
    distance = np.where(np.repeat(near, held, axis=0), (apart * apart).sum(2), np.iinfo(np.int64).max)
    return np.concatenate(whole), np.concatenate(chosen), places, distance.argmin(1)


def counted(t: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the number and the sum of the points that are nearest to it."""
    n, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    nodes, chosen, places, nearest = walk(t, entries)
    np.add.at(n, chosen, t.shape.end[nodes] - t.shape.start[nodes])
    np.add.at(sums, chosen, t.sums[nodes])
    np.add.at(n, nearest, 1)
    np.add.at(sums, nearest, t.points[places])
    return n, sums


def assigned(t: Tree, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point, in the points' own order; ties to the lower entry."""
    nodes, chosen, places, nearest = walk(t, entries)
    out = np.empty(len(t.points), np.int64)
    for a, b, e in zip(t.shape.start[nodes], t.shape.end[nodes], chosen, strict=True):
        out[t.order[a:b]] = e
    out[t.order[places]] = nearest
    return out


def _blocked(size: int):
    """Blocks of vectors: ids, labels, integers, and for each part's place the order of its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = finite(batch, size)
            x = np.floor(SCALE * x)
            if (np.abs(x) >= LARGEST).any():
                raise ValueError(f"components from {LARGEST // SCALE} on can't be compressed")
            x = np.pad(x.astype(np.int32), ((0, 0), (0, -size % PARTS)))
            for a in range(0, len(x), BLOCK):
                own, some = x[a : a + BLOCK], rows.slice(a, BLOCK)
                s = shape(len(own), LEAF)
                orders = [order_of(part, s).astype(np.int16) for part in np.split(own, PARTS, axis=1)]
                ends = pa.array([0, len(own)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, c) for c in (some.column(0).cast(pa.int64()), some.column(2))]
                blobs = [pa.array([v.tobytes()], pa.binary()) for v in (own, np.stack(orders))]
                yield pa.RecordBatch.from_arrays([*lists, *blobs], ["ids", "labels", "x", "orders"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(len(b)):
            ids, labels = b.column(0)[i].values, b.column(1)[i].values
            x = np.frombuffer(b.column(2)[i].as_buffer(), np.int32).reshape(-1, width).astype(np.int64)
            yield ids, labels, x, np.frombuffer(b.column(3)[i].as_buffer(), np.int16).reshape(PARTS, -1).astype(np.int64)


def _trees(x: np.ndarray, orders: np.ndarray) -> Iterator[Tree]:
    s = shape(len(x), LEAF)
    for part, order in zip(np.split(x, PARTS, axis=1), orders, strict=True):
        yield tree(part, order, s)


def _least(width: int):
    """Vectors that may be among those with the ``ENTRIES`` least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, x, _ in _blocks(batches, width):
            known = ids.drop_null().to_numpy()
            bound = np.sort(known)[ENTRIES - 1] if len(known) >= ENTRIES else None
            some = np.flatnonzero(ids.fill_null(np.iinfo(np.int64).max).to_numpy() <= bound) if bound is not None else np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(x[some].tolist(), pa.list_(pa.int64()))], ["vec_id", "x"])

    return run


def _round(width: int, books: np.ndarray):
    """Counts and sums of a task's parts by place, entry and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, _, x, orders in _blocks(batches, width):
            for p, t in enumerate(_trees(x, orders)):
                more, added = counted(t, books[p])
                n[p] += more
                sums[p] += added
        p, e, at = (v.ravel() for v in np.indices(books.shape))
        columns = [*(v.astype(np.int32) for v in (p, e, at)), n[p, e], sums.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "at", "n", "total"])

    return run


def _coded(width: int, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, orders in _blocks(batches, width):
            error, codes = np.zeros(len(x), np.int64), np.empty((len(x), PARTS), np.uint8)
            for p, (t, own) in enumerate(zip(_trees(x, orders), np.split(x, PARTS, axis=1), strict=True)):
                nearest = assigned(t, books[p])
                apart = own - books[p][nearest]
                error += (apart * apart).sum(1)
                codes[:, p] = nearest
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def fitted(blocks: DataFrame, width: int) -> np.ndarray:
    """The codebooks after all rounds: place, entry, component."""
    least = blocks.mapInArrow(_least(width), "vec_id long, x array<long>").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES)
    first = np.array([r["x"] for r in least.collect()], np.int64).reshape(-1, PARTS, width // PARTS)
    books = np.ascontiguousarray(first.transpose(1, 0, 2))
    for _ in range(ROUNDS):
        found = blocks.mapInArrow(_round(width, books), "part int, entry int, at int, n long, total long")
        after = books.copy()
        for r in found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect():
            after[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        books = after
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each row of ``vectors`` that takes part."""
    stages, kind = Stages(vectors.sparkSession, "compression"), vectors.schema[label].dataType
    size = usual_length(vectors)
    width = size + -size % PARTS
    rows = vectors.select("vec_id", "embedding", F.col(label).alias("label"))
    schema = T.StructType().add("ids", T.ArrayType(T.LongType())).add("labels", T.ArrayType(kind)).add("x", T.BinaryType()).add("orders", T.BinaryType())
    blocks = stages.keep((rows if size else rows.limit(0)).mapInArrow(_blocked(size), schema))
    books = fitted(blocks, width) if size else np.zeros((PARTS, 0, 0), np.int64)
    schema = T.StructType().add("vec_id", T.LongType()).add("label", kind).add("code", T.StringType()).add("error", T.LongType())
    coded = stages.keep(blocks.mapInArrow(_coded(width, books), schema))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("copies"))
    by_label = stages.keep(by_label)
    stages.only(coded, by_label)
    out = onto_rows(coded, by_label, "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
