"""N-gram Jaccard join by grouped prefixes, down to connected components.

1. Every text becomes the set of its n-word shingles (64-bit hashes). Shingles
   found often inside blocks of the corpus are ordered last, all others by hash.
   Any such order gives exact results; this one keeps the lists short.
2. Two sets of sizes n and m can only reach the threshold if they share an
   element of their prefixes, the first ``n - ceil(t * n) + 1`` elements in that
   order. Documents with equal size and prefix become one group, and only groups
   are joined on prefix elements, with the length filter and a filter on the number
   of elements that two prefixes share.
3. Groups are expanded, and pairs of members are verified on their whole sets.

Only components are asked for, so no list emits all its pairs. First each entry
of a list is paired with the list's hub (the entry that has the element earliest
in its prefix), members with the head of their group, and pairs that share
enough are verified. Then every remaining candidate pair whose ends are not yet in
one component is verified, so no link between components is missed: a pair
inside one component cannot change it.

Copies are collapsed by a 128-bit digest of their set before anything is joined.

Defined cases: null or empty texts have no shingles and are their own component;
texts with fewer words than n are one shingle; rows with equal doc_id count as
one document; a null doc_id is linked with nothing and its component is null;
extra columns are ignored; a very long text is one set, however large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm import words as W
from palisade.llm.components import components
from palisade.llm.frequent import most_frequent
from palisade.llm.store import Stages
from palisade.llm.workers import released

FEW = 1_000_000  # ids that may be broadcast; beyond, the join shuffles
BLOCK_TOKENS = 4_000_000  # shingles counted at once for the order
OFTEN = 2  # a shingle counts from so many documents of a block on
HOT = 8  # from so many documents on a shingle is ordered last
MOST_HOT = 200_000  # of the most frequent ones; all others are ordered by hash
LARGE, SHARE = 1000, 10_000  # groups of more copies than LARGE and than one in SHARE of all rows are broadcast: fewer than SHARE groups


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    w = W.words(texts)
    s, at = W.shingles(w, W.hashes(w), n)
    return [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _digest(s: np.ndarray) -> tuple[np.int64, np.int64]:
    if not len(s):
        return np.int64(0), np.int64(0)
    first, second = np.add.reduce(W.mix(s)), np.bitwise_xor.reduce(W.mix(s ^ np.uint64(0xA0761D6478BD642F)))
    return first.astype(np.int64), second.astype(np.int64)


def _frequent(n: int):
    """Shingles with their counts in blocks of the partition, if they count; equal sets of a block count once."""

    def flush(found: list[np.ndarray]) -> pa.RecordBatch:
        s, c = np.unique(np.concatenate(found), return_counts=True)
        often = c >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(s[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["token", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, known = [], 0, set()
        for whole in batches:
            for b in W.pieces(whole):
                for s in _sets(b.column(0), n):
                    if len(s) and (d := _digest(s)) not in known:
                        known.add(d)
                        found.append(s)
                        size += len(s)
                if size >= BLOCK_TOKENS:
                    yield flush(found)
                    found, size, known = [], 0, set()
        if found:
            yield flush(found)

    return run


def _prefixes(n: int, percent: int, hot_table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = hot_table.value
        maybe = np.zeros(1 << 16, bool)
        maybe[(hot & np.uint64(0xFFFF)).astype(np.int64)] = True
        for whole in batches:
            for b in W.pieces(whole):
                rows, prefixes = [], []
                for s in _sets(b.column(1), n):
                    size = len(s)
                    length = size - -(-percent * size // 100) + 1 if size else 0
                    prefix = s[:length]
                    if len(hot) and size:
                        could = maybe[(s & np.uint64(0xFFFF)).astype(np.int64)]
                        if could.any():
                            at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                            late = could & (hot[at] == s)
                            prefix = np.concatenate([s[~late], s[late][np.argsort(rank[at[late]])]])[:length]
                    rows.append((size, *_digest(s), *_digest(prefix)))
                    prefixes.append(prefix)
                at = np.zeros(len(prefixes) + 1, np.int32)
                np.cumsum([len(p) for p in prefixes], out=at[1:])
                values = pa.array(np.concatenate(prefixes).view(np.int64))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.ListArray.from_arrays(pa.array(at), values)], ["doc_id", "n", "d1", "d2", "p1", "p2", "prefix"])

    return run


def _encoded(n: int):
    """doc_id and the sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in W.pieces(whole):
                sets = pa.array([s.tobytes() for s in _sets(b.column(1), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), sets], ["id", "items"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(len(b), bool)
            left, right = b.column(2), b.column(3)
            for i in range(len(b)):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int(np.count_nonzero(y[at] == x))
                ok[i] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def only(docs: DataFrame, ids: DataFrame, column: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` with (or, left_anti, without) an id of ``ids``; these are broadcast if they are few."""
    ids = ids.distinct()
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, column, how)


class Join:
    """The join of one table with itself."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.percent = docs.select("doc_id", "text"), n, percent
        self.stages = Stages(docs.sparkSession, "ngram-join", tidy=True)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose whole sets reach the threshold."""
        pairs = self.stages.keep(pairs)
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
        found = only(self.docs, ids).mapInArrow(released(_encoded(self.n)), "id long, items binary").where("length(items) > 0")
        found = self.stages.keep(found)
        left = found.select(F.col("id").alias("a"), F.col("items").alias("left"))
        right = found.select(F.col("id").alias("b"), F.col("items").alias("right"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        out = self.stages.keep(both.mapInArrow(released(_verified(self.percent)), "a long, b long").distinct())
        self.stages.drop(found)
        self.stages.drop(pairs)
        return out

    @staticmethod
    def ordered(x: str, n: str, y: str, m: str) -> list[F.Column]:
        first = F.col(x) < F.col(y)
        pick = lambda p, q, name: F.when(first, F.col(p)).otherwise(F.col(q)).alias(name)
        return [pick(x, y, "a"), pick(n, m, "n"), pick(y, x, "b"), pick(m, n, "m")]

    def reach(self, shared: F.Column, n: str, m: str) -> F.Column:
        """Whether sets of sizes n, m can reach the threshold if their prefixes share so many elements.

        Every common element outside both prefixes is in the suffix of the set whose prefix ends first.
        """
        p = self.percent
        longest = F.greatest(F.ceil(F.col(n) * p / 100), F.ceil(F.col(m) * p / 100)) - 1
        lengths = 100 * F.least(n, m) >= p * F.greatest(n, m)
        return lengths & ((100 + p) * (shared + longest) >= p * (F.col(n) + F.col(m)))

    def run(self) -> DataFrame:
        spark, keep = self.docs.sparkSession, self.stages.keep
        seen = self.docs.select("text").mapInArrow(released(_frequent(self.n)), "token long, seen long")
        hot = seen.groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= HOT)
        hot = most_frequent(self.stages.keep(hot), "seen", MOST_HOT).toPandas()
        token = hot["token"].to_numpy(np.int64).view(np.uint64)
        order = np.lexsort((token, hot["seen"].to_numpy(np.int64)))
        rank = np.empty(len(token), np.int32)
        rank[order] = np.arange(len(token))
        by_token = np.argsort(token)
        table = spark.sparkContext.broadcast((token[by_token], rank[by_token]))
        made = self.docs.mapInArrow(released(_prefixes(self.n, self.percent, table)), "doc_id long, n long, d1 long, d2 long, p1 long, p2 long, prefix array<long>")
        texts = keep(made)
        used = texts.where("n > 0 AND doc_id IS NOT NULL")
        copies = used.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("copies"))
        groups = copies.groupBy("n", "p1", "p2").agg(F.min("rep").alias("gid"))
        members = keep(copies.join(groups, ["n", "p1", "p2"]).select("rep", "gid", "n", "p1", "p2"))
        heads = members.where("rep = gid").select(F.col("gid").alias("doc_id"))
        posted = only(used.select("doc_id", "n", "prefix"), heads).select(F.col("doc_id").alias("gid"), "n", F.posexplode("prefix").alias("pos", "token"))
        place = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")
        hubs = posted.groupBy("token").agg(F.count("*").alias("entries"), F.min_by("gid", place).alias("hub"), F.min(place).alias("place")).where("entries > 1")
        hubs = hubs.select("token", "hub", F.expr("place & 4294967295L").alias("hub_n"))
        lists = keep(posted.join(hubs, "token").select("token", "gid", "n", "pos", "hub", "hub_n"))

        # a pair shares several elements, and a hub stands for a part of them only; what this misses is found in the second round
        near = lists.where("gid <> hub").select(*self.ordered("gid", "n", "hub", "hub_n")).groupBy("a", "n", "b", "m").count()
        best = near.where(self.reach(3 * F.col("count"), "n", "m"))
        inner = members.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
        first = self.links(best.select("a", "b").unionByName(inner).distinct())
        known = components(first, self.stages)
        rest = self.links(self.unsettled(used.select("doc_id", "n", "prefix"), lists, members, known))
        final = components(first.unionByName(rest), self.stages)

        placed = copies.join(final, F.col("rep") == F.col("node"), "left")
        placed = keep(placed.select("n", "d1", "d2", "copies", F.coalesce("component", "rep").alias("component_id")))
        return self.spread(texts.select("doc_id", "n", "d1", "d2"), placed).select("doc_id", F.col("n").alias("n_shingles"), "component_id")

    @staticmethod
    def spread(texts: DataFrame, placed: DataFrame) -> DataFrame:
        """``texts`` with the component of their sets. Rows of large groups of copies stay where they are, so no task gets a whole group."""
        key, large = ["n", "d1", "d2"], F.col("copies") > max(LARGE, texts.count() // SHARE)
        linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        alone = texts.where(~linked).withColumn("component_id", F.col("doc_id"))
        few = F.broadcast(placed.where(large).drop("copies"))
        copied = texts.where(linked).join(few, key)
        others = texts.where(linked).join(few, key, "left_anti").join(placed.where(~large).drop("copies"), key)
        return alone.unionByName(copied).unionByName(others)

    def unsettled(self, prefixes: DataFrame, lists: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
        """All candidate pairs of members that are not yet in one component."""
        placed = self.stages.keep(members.join(known, F.col("rep") == F.col("node"), "left").select("rep", "gid", F.coalesce("component", "rep").alias("comp")))
        spread = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        entries = lists.select("token", "gid", "n", "pos").join(spread, "gid")
        mixed = entries.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("token")
        entries = self.stages.keep(entries.join(mixed, "token", "left_semi"))
        # the component with most entries of a list needs no pairs within itself: only the others are paired, with all
        weight = entries.where("low = high").groupBy("token", "low").count().groupBy("token").agg(F.max_by("low", "count").alias("main"))
        others = entries.join(weight, "token", "left")
        others = others.withColumn("out", F.expr("main IS NULL OR low <> main OR high <> main")).drop("main")
        x = others.where("out").select("token", *[F.col(c).alias(f"x_{c}") for c in ("gid", "n", "pos", "low", "high")])
        y = others.select("token", *[F.col(c).alias(f"y_{c}") for c in ("gid", "n", "pos", "low", "high", "out")])
        open_ = F.expr("NOT (x_low = x_high AND y_low = y_high AND x_low = y_low) AND (x_gid < y_gid OR (x_gid > y_gid AND NOT y_out))")
        # at the first element that two sets share, as much as the threshold asks for must still lie ahead in both
        p = self.percent
        ahead = F.expr(f"100 * least(x_n, y_n) >= {p} * greatest(x_n, y_n) AND {100 + p} * least(x_n - x_pos, y_n - y_pos) >= {p} * (x_n + y_n)")
        pairs = x.join(y, "token").where(open_ & ahead).select(*self.ordered("x_gid", "x_n", "y_gid", "y_n"))
        pairs = self.stages.keep(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct())
        # what is left meets by its whole prefixes, which are a small part of the sets
        wanted = only(prefixes, pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y"))).dropDuplicates(["doc_id"])
        left, right = (wanted.select(F.col("doc_id").alias(c), F.col("n").alias(f"{c}_n"), F.col("prefix").alias(f"{c}_prefix")) for c in "xy")
        met = pairs.join(left, "x").join(right, "y")
        pairs = met.where(self.reach(F.size(F.array_intersect("x_prefix", "y_prefix")), "x_n", "y_n")).select("x", "y")
        inside = spread.where("low < high").select(F.col("gid").alias("x"), F.col("gid").alias("y"))
        left = placed.select(F.col("gid").alias("x"), F.col("rep").alias("a"), F.col("comp").alias("comp_a"))
        right = placed.select(F.col("gid").alias("y"), F.col("rep").alias("b"), F.col("comp").alias("comp_b"))
        return pairs.unionByName(inside).join(left, "x").join(right, "y").where("comp_a <> comp_b AND (x <> y OR a < b)").select("a", "b").distinct()


def grouped(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``: documents link at ``percent`` of their union or more."""
    return Join(docs, n, percent).run()


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents of a component but its least doc_id."""
    join = Join(docs, n, percent)
    gone = Stages(docs.sparkSession, "ngram-gone").keep(join.run().where("doc_id <> component_id").select("doc_id"))
    join.stages.only()
    return only(docs, gone, how="left_anti").select(docs.columns)
