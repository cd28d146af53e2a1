"""Nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector then descends to its leaf,
and all vectors of a leaf lie together. A query walks the tree with a priority
queue: the node with the largest expected inner product is opened next, and
leaves come out in the order in which they promise most. How many leaves are
visited is calibrated: a set of queries is compared with all vectors in blocks,
and visits widen until their neighbours found reach ``RECALL``. A walk goes on
beyond that until its leaves hold k vectors besides the rows of the query's own id.

Leaves that follow one another make a group, and groups hold about equally many
vectors; a leaf of more is spread over several. A group is a partition: its
vectors come first and stay in memory, then the queries that visit any of its
leaves, each once, with a bit for each leaf. So a query is copied to groups and not
to the leaves it visits, and the number of groups only grows beyond
``GROUPS`` x ``GROUP`` vectors. Scores of what is found are computed on the
original vectors, in double precision and row by row, so equal vectors have
equal scores.

Defined cases: vectors that are null, zero, of another length than most, or
with null or non-finite components take no part, nor do rows without an id;
rows with equal ids are one candidate each but never the query's own; an empty
table gives an empty result; ties go to the smaller id; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from palisade.llm.store import Stages
from palisade.llm.workers import released

SAMPLE = 20_000  # vectors on which the tree is fitted
LEAF = 200  # vectors of a leaf, about
MOST_LEAVES = 4096
BRANCH = 8
CALIBRATION = 128  # queries compared with all vectors
RECALL = 0.96
GROUPS = 24  # groups of leaves, at least
GROUP = 500_000  # vectors of a group, about, at most
PACK = 1 << 16  # vectors held before packing
ROW = 512  # vectors of a packed row
ASKED = 2048  # queries of a packed row
SCORES = 1 << 20  # scores computed at a time; all of them may be ties


def valid(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part."""
    return _valid(batch, size)[:2]


def _valid(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and places of the rows that take part."""
    ids, lists = batch.column(0), batch.column(1)
    fits = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(lists), size), False), ids.is_valid())
    ids, lists = ids.filter(fits), lists.filter(fits)
    values = lists.flatten()
    x = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, size)
    ok = np.isfinite(x).all(1) & x.any(1)
    return ids.to_numpy(zero_copy_only=False)[ok], x[ok], np.flatnonzero(fits.to_numpy(zero_copy_only=False))[ok]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(8):
        near = ((centres * centres).sum(1) / 2 - x @ centres.T).argmin(1)
        for j in range(k):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return centres, ((centres * centres).sum(1) / 2 - x @ centres.T).argmin(1)


class Tree:
    """Nodes with the centres of their children; a node without children is a leaf, with a number."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 23):
        rng = np.random.default_rng(seed)
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.spread: list[np.ndarray] = []
        self.leaves = 0
        self._grow(x, leaves, rng)

    def _grow(self, x: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        node = len(self.children)
        for a, b in ((self.children, []), (self.centres, None), (self.leaf, -1), (self.spread, None)):
            a.append(b)
        k = min(BRANCH, leaves, len(np.unique(x[:2000], axis=0)) if len(x) else 0)
        if k < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
            return node
        centres, near = _kmeans(x, k, rng)
        self.centres[node] = centres
        self.spread[node] = np.array([np.sqrt(((x[near == j] - centres[j]) ** 2).sum(1).mean()) if (near == j).any() else 0.0 for j in range(k)])
        for j in range(k):
            own = x[near == j]
            self.children[node].append(self._grow(own, max(1, round(leaves * len(own) / len(x))), rng))
        return node

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                c = self.centres[node]
                near = ((c * c).sum(1) / 2 - x[rows] @ c.T).argmin(1)
                todo += [(child, rows[near == j]) for j, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in the order of the priority queue: ``most``, and more until they hold ``least`` vectors; ``held`` has those of each leaf."""
        length = float(np.sqrt(q @ q))
        queue, out, met = [(0.0, 0)], [], 0
        while queue and (len(out) < most or met < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                met += 0 if held is None else int(held[out[-1]])
                continue
            promise = self.centres[node] @ q + 0.5 * length * self.spread[node] / np.sqrt(len(q)) * 3
            for p, child in zip(promise.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-p, child))
        return out


class Walks:
    """The leaves that ``Tree.visits`` comes to, for many queries at once.

    The queue reaches a leaf when it opens the node of least promise above it, or the leaf itself. So the leaves whose
    least promise is greatest come first, and only below the node at the cut a queue is needed.
    """

    def __init__(self, tree: Tree, size: int):
        self.tree, nodes = tree, len(tree.children)
        self.centres, self.spread, self.above, self.levels = np.zeros((nodes, size)), np.zeros(nodes), np.zeros(nodes, np.int64), []
        level = [0]
        while level := [child for node in level for child in tree.children[node]]:
            self.levels.append(np.array(level))
        for node, children in enumerate(tree.children):
            if children:
                self.centres[children], self.spread[children], self.above[children] = tree.centres[node], tree.spread[node], node
        self.leaves = np.flatnonzero(np.array(tree.leaf) >= 0)
        self.leaves = self.leaves[np.argsort(np.array(tree.leaf)[self.leaves])]

    def seen(self, q: np.ndarray, most: int) -> np.ndarray:
        """Whether each query visits each leaf, ``most`` leaves a query."""
        if most >= self.tree.leaves:
            return np.ones((len(q), self.tree.leaves), bool)
        if len(q) > 256:
            return np.concatenate([self.seen(q[i : i + 256], most) for i in range(0, len(q), 256)])
        promise = q @ self.centres.T + (1.5 / np.sqrt(q.shape[1]) * np.sqrt((q * q).sum(1)))[:, None] * self.spread
        least = promise.copy()
        least[:, 0] = np.inf
        for level in self.levels:
            least[:, level] = np.minimum(promise[:, level], least[:, self.above[level]])
        at = least[:, self.leaves]
        low = np.partition(at, at.shape[1] - most, axis=1)[:, at.shape[1] - most, None]
        seen = at >= low
        for i in np.flatnonzero(seen.sum(1) > most):
            seen[i] = at[i] > low[i]
            tops = np.flatnonzero((least[i] == low[i]) & (least[i, self.above] > low[i]))
            queue = [(-promise[i, node], node) for node in tops.tolist()]
            heapq.heapify(queue)
            for _ in range(most - int(seen[i].sum())):
                while self.tree.children[queue[0][1]]:
                    for child in self.tree.children[heapq.heappop(queue)[1]]:
                        heapq.heappush(queue, (-promise[i, child], child))
                seen[i, self.tree.leaf[heapq.heappop(queue)[1]]] = True
        return seen


class Groups:
    """Groups of leaves; ``counts`` has the vectors of each leaf, which lie in the groups from ``first`` to ``last``."""

    def __init__(self, counts: np.ndarray):
        total, ends = max(1, int(counts.sum())), np.cumsum(counts)
        self.counts, self.n = counts, max(GROUPS, -(-total // GROUP))
        self.first = (ends - counts) * self.n // total
        self.last = np.maximum(self.first, (ends - 1) * self.n // total)

    def leaves(self, group: int) -> np.ndarray:
        return np.flatnonzero((self.counts > 0) & (self.first <= group) & (group <= self.last))


def _pack(shared, size: int, kind: type):
    """Rows (leaf, n, ids, vectors): vectors by their leaf, as numbers of ``kind``."""

    def flush(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        leaf = shared.value.place(x)
        rows = np.argsort(leaf, kind="stable")
        leaf = leaf[rows]
        at = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else np.zeros(0, int)
        spans = [(i, min(i + ROW, b)) for a, b in zip(at, np.append(at[1:], len(leaf)), strict=True) for i in range(a, b, ROW)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(leaf[a]) for a, _ in spans], pa.int32()),
                pa.array([int(b - a) for a, b in spans], pa.int64()),
                pa.array([ids[rows[a:b]].tobytes() for a, b in spans], pa.binary()),
                pa.array([x[rows[a:b]].astype(kind).tobytes() for a, b in spans], pa.binary()),
            ],
            ["leaf", "n", "ids", "vectors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(valid(b, size))
            n += len(held[-1][0])
            if n >= PACK:
                yield flush(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield flush(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return released(run)


_MET = "group int, asked boolean, leaf int, ids binary, vectors binary, seen binary"


def _asked(shared, size: int, kind: type, most: int, k: int):
    """Rows of ``_MET``: queries by each group in which they visit a leaf, with a bit for each leaf of the group.

    A third column has the rows of a query's own id. A walk visits ``most`` leaves, and more until they hold k other vectors.
    """

    def packed(walks: Walks, groups: Groups, ids: np.ndarray, x: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen = walks.seen(x, most)
        for i in np.flatnonzero(seen @ groups.counts < k + own):
            seen[i, walks.tree.visits(x[i], most, groups.counts, k + int(own[i]))] = True
        for group in range(groups.n):
            visits = seen[:, groups.leaves(group)]
            rows = np.flatnonzero(visits.any(1))
            if len(rows):
                row = {"group": group, "asked": True, "leaf": None, "ids": ids[rows].tobytes(), "vectors": x[rows].astype(kind).tobytes(), "seen": np.packbits(visits[rows], axis=1).tobytes()}
                yield pa.RecordBatch.from_pylist([row], pa.schema({"group": pa.int32(), "asked": pa.bool_(), "leaf": pa.int32(), "ids": pa.binary(), "vectors": pa.binary(), "seen": pa.binary()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, groups = shared.value
        walks = Walks(tree, size)
        for b in batches:
            ids, x, ok = _valid(b, size)
            own = b.column(2).to_numpy(zero_copy_only=False)[ok]
            for i in range(0, len(ids), ASKED):
                yield from packed(walks, groups, ids[i : i + ASKED], x[i : i + ASKED], own[i : i + ASKED])

    return released(run)


class Best:
    """The k best candidates of each of some queries so far; ``least`` is what a further one has to reach."""

    def __init__(self, k: int, qids: np.ndarray, q: np.ndarray):
        self.k, self.qids, self.q, self.held, self.n = k, qids, q, [], 0
        self.least, self.known = np.full(len(qids), -np.inf), np.sort(qids)
        self.most = self.room = max(100_000, 4 * k * len(qids))

    def add(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray, leaf: int) -> None:
        """Compare the queries at ``at`` with vectors of a leaf."""
        rough = self.q[at] @ x.T
        own = self.known[np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)] == ids
        for i in np.flatnonzero(own):
            rough[self.qids[at] == ids[i], i] = -np.inf
        low = self.least[at]
        new = np.flatnonzero(low == -np.inf)
        if len(new) and len(ids) > self.k:
            low[new] = np.partition(rough[new], len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            self.least[at] = low
        near = (rough >= (low - 1e-9 * (1 + np.abs(np.where(np.isfinite(low), low, 0))))[:, None]) & np.isfinite(rough)
        row, column = np.nonzero(near)
        if len(row):
            row = at[row]
            exact = np.concatenate([(x[column[i : i + 4096]] * self.q[row[i : i + 4096]]).sum(1) for i in range(0, len(row), 4096)])
            self.held.append((row, ids[column], exact, np.full(len(row), leaf)))
            self.n += len(row)
        if self.n > self.most:
            self._prune()
            self.most = max(self.room, 2 * self.n)

    def _prune(self) -> None:
        row, ids, score, leaf = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, row))
        row, ids, score, leaf = row[order], ids[order], score[order], leaf[order]
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        counts = np.diff(np.append(start, len(row)))
        full = start[counts >= self.k]
        self.least[row[full]] = np.maximum(self.least[row[full]], score[full + self.k - 1])
        keep = np.arange(len(row)) - np.repeat(start, counts) < self.k
        self.held, self.n = [(row[keep], ids[keep], score[keep], leaf[keep])], int(keep.sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            self._prune()
            row, ids, score, leaf = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (self.qids[row].astype(np.int64), ids, score, leaf.astype(np.int32))], ["query_id", "vec_id", "score", "leaf"])


_FOUND = "query_id long, vec_id long, score double, leaf int"


def _matrix(data: pa.Scalar, size: int, kind: type) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), kind).reshape(-1, size)


def _search(shared, size: int, kind: type, k: int):
    """The k best of each query in each group; a group's vectors come before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, now, held = shared.value[1], None, {}
        for b in batches:
            for group, leaf, ids, x, seen in zip(b.column("group").to_pylist(), b.column("leaf").to_pylist(), *(b.column(c) for c in ("ids", "vectors", "seen")), strict=True):
                if group != now:
                    now, held = group, {}
                ids, x = np.frombuffer(ids.as_buffer(), np.int64), _matrix(x, size, kind)
                if leaf is not None:
                    held.setdefault(leaf, []).append((ids.copy(), x.copy()))
                    continue
                leaves = groups.leaves(group)
                visits = np.unpackbits(np.frombuffer(seen.as_buffer(), np.uint8).reshape(len(ids), -1), axis=1, count=len(leaves)).view(bool)
                best = Best(k, ids, x.astype(np.float64))
                for i, leaf in enumerate(leaves.tolist()):
                    at = np.flatnonzero(visits[:, i])
                    if len(at) and leaf in held:
                        held[leaf] = [tuple(np.concatenate(c) for c in zip(*held[leaf], strict=True))] if len(held[leaf]) > 1 else held[leaf]
                        of, y = held[leaf][0]
                        step = max(64, SCORES // len(at))
                        for a in range(0, len(of), step):
                            best.add(at, of[a : a + step], y[a : a + step].astype(np.float64), leaf)
                yield from best.rows()

    return released(run)


def _exact(shared, size: int, kind: type, k: int):
    """The k best of each calibration query among the packed vectors of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, *shared.value)
        every = np.arange(len(best.qids))
        for b in batches:
            for leaf, ids, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                best.add(every, np.frombuffer(ids.as_buffer(), np.int64), _matrix(x, size, kind).astype(np.float64), leaf)
        yield from best.rows()

    return released(run)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _spread(rows: DataFrame, most: int, n: int) -> DataFrame:
    """About ``most`` of n rows, by a hash of the id."""
    return rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, n))))


def _driver(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = [valid(b, size) for b in rows.toArrow().to_batches()]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros((0, size)))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query row among all other rows."""
    spark = vectors.sparkSession
    stages = Stages(spark, "neighbours")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = rows.where(is_query)
    sizes = rows.where("vec_id IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), "size").first()
    size, n = (common["size"], common["count"]) if common else (1, 0)
    _, x = _driver(_spread(rows, SAMPLE, n), size)
    tree = Tree(x, int(min(MOST_LEAVES, max(1, n // LEAF), max(1, len(x) // 4))))
    shared = spark.sparkContext.broadcast(tree)
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64  # packed without a loss
    packed = stages.keep(rows.mapInArrow(_pack(shared, size, kind), "leaf int, n long, ids binary, vectors binary"))

    qid, q = _driver(_spread(queries, CALIBRATION, n // 20), size)
    most = tree.leaves
    if len(qid):
        asked = spark.sparkContext.broadcast((qid, q))
        truth = _top(packed.select("leaf", "ids", "vectors").mapInArrow(_exact(asked, size, kind, k), _FOUND), k).toPandas()
        place = {i: {leaf: at for at, leaf in enumerate(tree.visits(v, tree.leaves))} for i, v in zip(qid.tolist(), q, strict=True)}
        needed = np.sort([place[i][leaf] + 1 for i, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
        if len(needed):
            most = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)])

    counts = np.zeros(tree.leaves, np.int64)
    for r in packed.groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["leaf"]] = r["n"]
    groups = Groups(counts)
    shared = spark.sparkContext.broadcast((tree, groups))
    spans = spark.createDataFrame(list(zip(range(tree.leaves), groups.first.tolist(), (groups.last - groups.first + 1).tolist(), strict=True)), "leaf int, first int, n_groups int")
    group = F.col("first") + F.pmod(F.xxhash64("ids"), F.col("n_groups")).cast("int")
    none = F.lit(None).cast("binary")
    held = packed.join(F.broadcast(spans), "leaf").select(group.alias("group"), F.lit(False).alias("asked"), "leaf", "ids", "vectors", none.alias("seen"))  # one row for each leaf, at most MOST_LEAVES and a few
    copies = rows.groupBy("vec_id").agg(F.count("*").alias("own"))
    queries = queries.join(copies, "vec_id").select("vec_id", "embedding", "own")  # copies of its own id are no candidates of a query
    asked = queries.repartition(groups.n).mapInArrow(_asked(shared, size, kind, most, k), _MET)
    met = held.unionAll(asked).repartitionById(groups.n, F.col("group")).sortWithinPartitions("group", "asked")
    found = met.mapInArrow(_search(shared, size, kind, k), _FOUND).select("query_id", "vec_id", "score")
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
