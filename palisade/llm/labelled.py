"""Labelled training rows: a bounded sample, spread by a hash, of rows outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOTAL = 60_000_000  # characters of all training texts of a class; texts that no longer fit are left out of training, never of scoring


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of doc_id as text, modulo 5; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` rows of each class whose fold is not 0, texts whole whatever their length.

    The rows are those with the least hashes, chosen on ``labels`` alone, so only their ids are joined with ``docs``.
    A class's count tells below which hash they lie, so tasks send few more than ``most`` rows in all to be cut.
    Lengths are read first, so that the driver never holds more than ``TOTAL`` characters of a class.

    Where labels contradict each other, 1 counts; where a doc_id has several texts, the least is taken.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).alias(label))
    count = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    h, some = F.xxhash64("doc_id"), None
    for value in (0, 1):
        # six deviations above the expected number; the bound only saves work, as the least hashes lie below it
        share = (most + 6 * most**0.5 + 50) / max(1, count.get(value, 0))
        below = h <= int(-(1 << 63) + share * 2**64) if share < 1 else F.lit(True)
        one = known.where((F.col(label) == value) & below).orderBy(h, "doc_id").limit(most)
        some = one if some is None else some.unionByName(one)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(some), "doc_id")
    sizes = rows.groupBy("doc_id", label).agg(F.sum(F.length("text").cast("long")).alias("size"), F.xxhash64("doc_id").alias("h")).collect()
    left, out = {0: TOTAL, 1: TOTAL}, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] > left[r[label]]:
            out.append(r["doc_id"])
        else:
            left[r[label]] -= r["size"]
    if out:
        rows = rows.where(~F.col("doc_id").isin(out))
    got = rows.select("doc_id", "text", label).toPandas().sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
    return got["text"].tolist(), got[label].astype(int).tolist()
