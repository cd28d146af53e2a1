"""Canonical exact digests of documents.

A text's canonical form is its NFKC form, case-folded, with runs of white space
folded to one space. Its digest is the 128-bit xxhash of that form. Inside
buckets of equal digests the canonical bytes of the documents are compared, and
the forms of edited texts, which are nowhere stored, by their SHA-256. Should two
different forms ever share a digest, the fingerprints of that bucket, edited ones
too, get a SHA-256 suffix that tells them apart.

Every document meets its successor in one pass over ranges of ids, which Spark
sorts; texts travel compressed, and the number of ranges grows with the table.

Defined cases: null text counts as empty; the next document is the one with the
next greater doc_id (rows with equal doc_id follow each other by a digest of
their texts), after the last comes the first, a single document follows itself;
null doc_id comes before all others; an empty table gives an empty result; very
long texts are read whole, two documents at a time; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import Stages

FEW = 1_000_000  # ids that may be broadcast; beyond, the join shuffles
FEW_DIGESTS = 200_000  # the same for digests
NO_ID = -(1 << 63)  # stands for a null doc_id
Digest = Callable[[bytes], str]


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def _witness(form: bytes) -> str:
    return hashlib.sha256(form).hexdigest()[:32]


def _dealt(starts: list[int]):
    """Rows with the number of the id range they fall in; a range's first row also goes, as its tail, to the range before."""
    edge = np.array(starts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            part = np.searchsorted(edge, ids, "right") - 1
            raw = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array([xxhash.xxh3_128_hexdigest(x) for x in raw]), pa.array([len(x) for x in raw], pa.int64())]
            full = pa.RecordBatch.from_arrays([*columns, pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], _DEALT[2:])
            head = np.flatnonzero(np.isin(ids, edge))
            for rows, of, tail in ((full, part, False), (full.take(pa.array(head)), (part[head] - 1) % len(edge), True)):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(np.full(len(rows), tail)), *rows.columns], _DEALT)

    return run


_DEALT = ["part", "tail", "id", "doc_id", "tie", "size", "body"]
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, witness string, edited_fingerprint string, edited_witness string, near_edited double, near_next double"


class _Doc:
    def __init__(self, doc_id: int | None, text: bytes, digest: Digest):
        self.doc_id, self.text = doc_id, text.decode("utf-8", "replace")
        self.form = canonical(self.text)
        self.digest = digest(self.form)

    def row(self, after: _Doc, digest: Digest) -> tuple:
        half = len(self.text) // 2
        edited = self.text[: len(self.text) - half] + after.text[:half]
        form = canonical(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (self.doc_id, len(self.text), sha, self.digest, _witness(self.form), digest(form), _witness(form), float(form == self.form), float(after.form == self.form))


def _paired(digest: Digest):
    """Rows sorted by (part, tail, id, tie): each with the row after it. One document and the next are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        names = [c.split()[0] for c in _OUT.split(", ")]
        before, part, out = None, None, []
        for b in batches:
            for p, tail, doc_id, size, body in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 5)), b.column(6), strict=True):
                if tail and (before is None or p != part):
                    continue
                doc = _Doc(doc_id, codec.decompress(body.as_buffer(), size, asbytes=True), digest)
                if before is not None and p == part:
                    out.append(before.row(doc, digest))
                before, part = None if tail else doc, p
                if len(out) >= 2000:
                    yield _batch(out, names)
                    out = []
        if out:
            yield _batch(out, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 5, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _forms(digest: Digest):
    """Digest and compressed form of each text; compression is a function of the bytes and can be undone, so forms are equal where these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for b in batches:
            for i in range(0, len(b), 500):
                texts = b.column(0).slice(i, 500).cast(pa.binary()).to_pylist()
                forms = [canonical((x or b"").decode("utf-8", "replace")) for x in texts]
                packed = [codec.compress(x, asbytes=True) for x in forms]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in forms]), pa.array(packed, pa.binary())], ["found", "form"])

    return run


def _few(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= most else rows


def shared_digests(docs: DataFrame, found: DataFrame, digest: Digest = digest) -> DataFrame:
    """Digests under which ``docs`` has different canonical bytes.

    ``found`` has doc_id and fingerprint. Only texts in buckets of two and more
    are read again; the least and the greatest form of a bucket are kept for
    each task before the shuffle, so a bucket of any size stays two rows.
    """
    many = found.groupBy("fingerprint").count().where("count > 1").select("fingerprint")
    members = found.join(_few(many, FEW_DIGESTS), "fingerprint", "left_semi")
    ids = members.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).distinct()
    again = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).join(_few(ids, FEW), "id", "left_semi").select("text")
    forms = again.mapInArrow(_forms(digest), "found string, form binary")
    return forms.groupBy("found").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("found")


def _ordered(docs: DataFrame) -> DataFrame:
    """Each document and, in its order, the one after it: ranges of ids in partitions of their own, sorted."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "doc_id", "text")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions())  # the scan's splits grow with the table
    steps = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = rows.agg(F.min("id").alias("low"), F.percentile_approx("id", steps, F.lit(max(1000, 4 * n))).alias("others")).first()
    starts = sorted({bounds["low"], *(bounds["others"] or [])}) if bounds["low"] is not None else [0]
    kinds = "part int, tail boolean, id long, doc_id long, tie string, size long, body binary"
    return rows.mapInArrow(_dealt(starts), kinds).repartitionById(len(starts), F.col("part")).sortWithinPartitions("part", "tail", "id", "tie")


def edited_fingerprints(docs: DataFrame, digest: Digest = digest) -> DataFrame:
    """Fingerprints of each text and of its edited text: see ``op4`` in the queries for the columns."""
    stages = Stages(docs.sparkSession, "fingerprints")
    found = stages.keep(_ordered(docs).mapInArrow(_paired(digest), _OUT))
    every = found.select("fingerprint", "witness").unionAll(found.select("edited_fingerprint", "edited_witness"))
    told = every.groupBy(F.col("fingerprint").alias("found")).agg(F.min("witness").alias("low"), F.max("witness").alias("high"))
    shared = told.where("low <> high").select("found").union(shared_digests(docs.select("doc_id", "text"), found, digest))
    shared = stages.keep(shared.distinct())
    clashes = shared.count()
    for name, proof in (("fingerprint", "witness"), ("edited_fingerprint", "edited_witness")) if clashes else ():
        clash = shared.withColumnRenamed("found", name).withColumn("clash", F.lit(True))
        clash = F.broadcast(clash) if clashes <= FEW_DIGESTS else clash
        found = found.join(clash, name, "left").withColumn(name, F.when(F.col("clash"), F.concat_ws("-", name, proof)).otherwise(F.col(name))).drop("clash")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
