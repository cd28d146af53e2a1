"""A positional inverted index over documents, kept up to date by segments.

A segment holds, for each token and document, the positions of the token; it is
written in buckets by a hash of the token and sorted by token inside, so a search
reads the buckets of its terms, and of these the row groups that hold the terms.
An update writes a new segment, and the ids of the documents that it replaces or
deletes as dead for all segments before it; ``compact`` makes one segment of what is
left, without reading a text again. Each change is an entry of a log (see
``palisade.sources.versions``), which also holds the numbers of documents and tokens.

A phrase stands where the positions of its tokens, each less its place in the
phrase, meet. Columns follow each other with a gap that no phrase spans.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.retrieval import folded, holding, phrase_tokens, query_terms, ranked
from palisade.sources.staging import staged
from palisade.sources.versions import Conflict, Log

GAP = 8  # positions between columns
ROWS = 100_000  # postings that a task holds at once before it hands them on
FEW = 2_000_000  # dead ids that may be broadcast; beyond, the join shuffles
POSTINGS = "token string, id long, tag string, size int, at array<int>"
DOCS = "id long, tag string, size int"


def _size(plain: Column) -> Column:
    """Number of tokens of a folded text."""
    return F.size(F.filter(F.split(plain, " +"), lambda t: t != ""))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``POSTINGS`` of documents, each by itself: id, tag, size and for each column its folded text, t0.., and where it starts, s0.."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        token, id_, tag, size, at = zip(*out, strict=True)
        columns = [pa.array(token, pa.string()), pa.array(id_, pa.int64()), pa.array(tag, pa.string()), pa.array(size, pa.int32()), pa.array(at, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["token", "id", "tag", "size", "at"])

    for batch in batches:
        out, n = [], (batch.num_columns - 3) // 2
        for i in range(batch.num_rows):
            id_, tag, size, *rest = (c[i].as_py() for c in batch.columns)
            places: dict[str, list[int]] = {}
            for text, start in zip(rest[:n], rest[n:], strict=True):
                for at, token in enumerate((t for t in text.split(" ") if t), start):
                    places.setdefault(token, []).append(at)
            out += [(token, id_, tag, size, at) for token, at in places.items()]
            if len(out) >= ROWS:
                yield rows(out)
                out = []
        if out:
            yield rows(out)


def _less(places: Column, i: int) -> Column:
    return F.transform(places, lambda x: x - i) if i else places


class TextIndex(Log):
    """An index in a folder. Ids are integers without nulls, one document each; ``tag`` is a value that searches may ask for."""

    @classmethod
    def create_from(cls, spark: SparkSession, root: str, docs: DataFrame, columns: list[str], id_column: str = "doc_id", tag_column: str = "source", buckets: int = 64) -> TextIndex:
        index = cls(spark, root)
        entry = {"columns": columns, "id": id_column, "tag": tag_column, "buckets": buckets, "segments": [], "dead": [], "docs": 0, "tokens": 0}
        if not index.create(0, index._with_segment(entry, docs, 0)):
            raise Conflict(f"there is an index in {root}")
        return index

    def _with_segment(self, entry: dict, docs: DataFrame, order: int) -> dict:
        """The entry with a segment of ``docs``, which is written."""
        n, at = len(entry["columns"]), f"segments/{uuid.uuid4().hex}"
        texts = docs.select(F.col(entry["id"]).cast("long").alias("id"), F.col(entry["tag"]).cast("string").alias("tag"), *[F.coalesce(folded(F.col(c)), F.lit("")).alias(f"t{i}") for i, c in enumerate(entry["columns"])])
        sized = texts.select("*", *[_size(F.col(f"t{i}")).alias(f"n{i}") for i in range(n)])
        starts = [reduce(lambda a, b: a + b, [F.col(f"n{j}") + GAP for j in range(i)], F.lit(0)).alias(f"s{i}") for i in range(n)]
        size = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(n)]).alias("size")
        placed = sized.select("id", "tag", size, *[f"t{i}" for i in range(n)], *starts).mapInArrow(_postings, POSTINGS)
        self._write_postings(placed, at, entry["buckets"])
        return self._added(entry, sized.select("id", "tag", size), at, order)

    def _write_postings(self, postings: DataFrame, at: str, buckets: int) -> None:
        """Each task writes what it has of each bucket, in order of the tokens, so nothing is shuffled, and a bucket has as many files as there are tasks."""
        rows = postings.select("token", "id", "tag", "size", "at", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket"))
        rows.sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(f"{self.root}/{at}/postings")

    def _added(self, entry: dict, docs: DataFrame, at: str, order: int) -> dict:
        docs.write.parquet(f"{self.root}/{at}/docs")
        n, total = self.spark.read.schema(DOCS).parquet(f"{self.root}/{at}/docs").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        segments = [*entry["segments"], {"at": at, "order": order}]
        return entry | {"segments": segments, "docs": entry["docs"] + n, "tokens": entry["tokens"] + total}

    def _segments(self, entry: dict, below: str, schema: str) -> DataFrame:
        """Rows of all segments with their order."""
        parts = []
        for s in entry["segments"]:
            path = f"{self.root}/{s['at']}/{below}"
            read = self.spark.read.schema(f"{schema}, bucket int" if below == "postings" else schema)
            parts.append(read.parquet(path).withColumn("order", F.lit(s["order"])))
        return reduce(DataFrame.unionByName, parts)

    def _alive(self, rows: DataFrame, entry: dict) -> DataFrame:
        """``rows`` of segments without those that a later change made dead."""
        if not entry["dead"]:
            return rows
        dead = [self.spark.read.schema(DOCS).parquet(f"{self.root}/{d['at']}").select("id", F.lit(d["order"]).alias("gone")) for d in entry["dead"]]
        dead = reduce(DataFrame.unionByName, dead).groupBy("id").agg(F.max("gone").alias("gone"))
        few = sum(d["rows"] for d in entry["dead"]) <= FEW
        return rows.join(F.broadcast(dead) if few else dead, "id", "left").where("gone IS NULL OR gone <= order").drop("gone")

    def _changed(self, ids: DataFrame, docs: DataFrame | None, tries: int = 10) -> int:
        for _ in range(tries):
            number, entry = self.latest()
            order, at = number + 1, f"dead/{uuid.uuid4().hex}"
            gone = self._alive(self._segments(entry, "docs", DOCS), entry).join(ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
            gone.select("id", "tag", "size").write.parquet(f"{self.root}/{at}")
            n, total = self.spark.read.schema(DOCS).parquet(f"{self.root}/{at}").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            if n:
                entry = entry | {"dead": [*entry["dead"], {"at": at, "order": order, "rows": n}], "docs": entry["docs"] - n, "tokens": entry["tokens"] - total}
            if self.create(order, entry if docs is None else self._with_segment(entry, docs, order)):
                return order
        raise Conflict(f"no change of {self.root} could be committed in {tries} tries")

    def upsert(self, docs: DataFrame) -> int:
        """Put documents in, instead of those with their ids."""
        return self._changed(docs.select(self.latest()[1]["id"]), docs)

    def delete_ids(self, ids: DataFrame) -> int:
        """Delete the documents whose ids are the first column of ``ids``."""
        return self._changed(ids, None)

    def compact(self) -> int:
        """Make one segment of all that is alive."""
        number, entry = self.latest()
        at, order = f"segments/{uuid.uuid4().hex}", number + 1
        self._write_postings(self._alive(self._segments(entry, "postings", POSTINGS), entry), at, entry["buckets"])
        fresh = self._added(entry | {"segments": [], "dead": [], "docs": 0, "tokens": 0}, self._alive(self._segments(entry, "docs", DOCS), entry).select("id", "tag", "size"), at, order)
        if not self.create(order, fresh):
            raise Conflict(f"{self.root} was changed while it was compacted")
        return order

    def postings(self, some: list[str]) -> DataFrame:
        """Postings of the given tokens in documents that are alive; only the tokens' buckets are read."""
        _, entry = self.latest()
        wanted = self.spark.createDataFrame([(t,) for t in some], "token string")
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("token"), F.lit(entry["buckets"]))).distinct().collect()]
        rows = self._segments(entry, "postings", POSTINGS)
        return self._alive(rows.where(F.col("bucket").isin(buckets) & F.col("token").isin(some)), entry)

    def counted(self, terms: list[str]) -> DataFrame:
        """id, tag, size and the frequencies f0.. of the terms, of documents that hold one of their tokens."""
        phrases = [t for t in dict.fromkeys(tuple(phrase_tokens(t)) for t in terms) if t]
        some = sorted({t for p in phrases for t in p})
        at = {t: f"p{i}" for i, t in enumerate(some)}
        lists = [F.max(F.when(F.col("token") == t, F.col("at"))).alias(c) for t, c in at.items()]
        found = self.postings(some).groupBy("id").agg(F.first("tag").alias("tag"), F.first("size").cast("double").alias("size"), *lists)

        def frequency(phrase: tuple[str, ...]) -> Column:
            starts = [_less(F.col(at[t]), i) for i, t in enumerate(phrase)]
            return F.coalesce(F.size(reduce(F.array_intersect, starts)), F.lit(0)).cast("double")

        return found.select("id", "tag", "size", *[F.when(reduce(lambda a, b: a & b, [F.col(at[t]).isNotNull() for t in p]), frequency(p)).otherwise(0.0).alias(f"f{i}") for i, p in enumerate(phrases)])

    def bm25(self, terms: list[str], k: int = 3) -> DataFrame:
        """id, score as ``retrieval.bm25`` gives them, from the terms' postings and the log's numbers."""
        _, entry = self.latest()
        n = len([t for t in dict.fromkeys(tuple(phrase_tokens(t)) for t in terms) if t])
        counted = staged(self.counted(terms), "postings")
        corpus = counted.agg(F.lit(float(entry["docs"])).alias("docs"), F.lit(entry["tokens"] / max(1, entry["docs"])).alias("mean"), *holding(n))
        return ranked(counted, corpus, n, k, "id").withColumnRenamed("id", entry["id"])

    def found(self, text: str, tag: str | None = None) -> DataFrame:
        """id and tag of the documents that hold one of the terms of ``text``; of all documents without a term."""
        _, entry = self.latest()
        terms = [t for t in query_terms(text) if phrase_tokens(t)]
        if terms:
            counted = self.counted(terms)
            rows = counted.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in counted.columns[3:]])).select("id", "tag")
        elif text.strip():
            raise ValueError("a text without a term is not in the index; search the documents themselves")
        else:
            rows = self._alive(self._segments(entry, "docs", DOCS), entry).select("id", "tag")
        return rows.where(F.col("tag") == tag) if tag else rows

    def search(self, text: str, tag: str | None = None, before: int | None = None, size: int = 20) -> DataFrame:
        """A page of ``found``, newest id first, of ids below ``before``: the last id of the page before."""
        _, entry = self.latest()
        rows = self.found(text, tag)
        rows = rows if before is None else rows.where(F.col("id") < before)
        return rows.orderBy(F.desc("id")).limit(size).withColumnsRenamed({"id": entry["id"], "tag": entry["tag"]})

    def total(self, text: str, tag: str | None = None) -> DataFrame:
        return self.found(text, tag).agg(F.count("*").alias("total"))
