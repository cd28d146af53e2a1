"""SimHash near-duplicates found through deletion variants of fingerprint segments.

A text's fingerprint has a bit set where over half of its shingles' hashes have
it. Fingerprints within two bits of each other differ by at most one bit in one
of their two 32-bit segments. So each segment is indexed once for each of its
bits, with that bit blotted out: fingerprints with a segment that differs by at
most one bit meet in an equal key, and all that meet are compared whole.

1. Texts become fingerprints; equal ones become one row with its least doc_id.
2. The 64 keys of each fingerprint are counted. Two that meet alone are compared
   at once, those of keys with up to ``LIMIT`` fingerprints by a join on the key.
3. Keys with more fingerprints are not paired out. Their fingerprints are keyed by
   themselves and by the 64 values one bit away: two are within two bits exactly
   if they share such a value, at most 65 share one, and all that share it are
   linked. So no link is lost, and rows stay in proportion to the fingerprints.
4. Links become components, whose least doc_id goes back to all rows.

Defined cases: texts without a word have fingerprint zero and are linked like any
other; fewer words than a shingle's count as one shingle; null texts are empty; rows
with equal doc_id are linked each by its own text; a null doc_id has its
fingerprint, but no component and no links; extra columns are ignored; a very long
text is read in blocks of words; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.components import components
from palisade.llm.groups import onto_rows
from palisade.llm.store import Stages

SEED = 42
BLOCK = 1 << 20  # bytes of a text cut into words at once
NEAR = 2  # bits
LIMIT = 16  # fingerprints of a key that are compared pair by pair
FEW = 1_000_000  # keys that may be broadcast; beyond, the join shuffles
PART = 500_000  # variants of a partition, about
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        stop = _SPACE.search(data, at + BLOCK)
        end = stop.start() if stop else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: bytes, n: int = 3) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number."""
    ones, total, left = np.zeros(64, np.int64), 0, []

    def add(shingles: list[bytes]) -> int:
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        ones[:] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return len(shingles)

    for found in _words(text.lower()):
        w = left + found
        total += add([b" ".join(s) for s in zip(*(w[i:] for i in range(n)), strict=False)])
        left = w[max(0, len(w) - n + 1) :]
    if not total and left:
        total += add([b" ".join(left)])
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def _prints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fingerprint(t.as_py() or b"", n) for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], ["doc_id", "print"])

    return run


def variants(prints: DataFrame) -> DataFrame:
    """key, print: each segment of each ``print`` without one of its bits, with the segment's and the bit's number."""
    segment = "shiftrightunsigned(print, shiftright(at, 5) * 32) & 4294967295L"
    key = F.expr(f"shiftleft({segment} & ~shiftleft(1L, at & 31), 6) | at")
    return prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at")).select(key.alias("key"), "print")


def neighbourhoods(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all of ``print`` within two bits of each other, by what is at most one bit away from both."""
    near = F.expr("concat(array(print), transform(sequence(0, 63), i -> print ^ shiftleft(1L, i)))")
    met = prints.select("print", F.explode(near).alias("near")).groupBy("near").agg(F.collect_set("print").alias("all")).where(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")


def links(prints: DataFrame, stages: Stages) -> DataFrame:
    """Links (a, b) between different values of ``print`` whose components are those of all values within ``NEAR`` bits."""
    index = variants(prints)
    met = index.groupBy("key").agg(F.count("*").alias("held"), F.min("print").alias("a"), F.max("print").alias("b")).where("held > 1")
    met = stages.keep(met)
    close = f"bit_count(a ^ b) <= {NEAR}"
    alone = met.where(f"held = 2 AND {close}").select("a", "b")
    several = met.where("held > 2").select("key", "held")
    n = several.count()
    if not n:
        return alone.distinct()
    listed = stages.keep(index.join(F.broadcast(several) if n <= FEW else several, "key"))
    few = listed.where(f"held <= {LIMIT}")
    x, y = few.select("key", F.col("print").alias("a")), few.select(F.col("key").alias("k"), F.col("print").alias("b"))
    paired = x.join(y, F.expr(f"key = k AND a < b AND {close}")).select("a", "b")
    many = neighbourhoods(listed.where(f"held > {LIMIT}").select("print").distinct())
    return alone.unionByName(paired).unionByName(many).distinct()


def grouped(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``; shingles have ``n`` words."""
    stages = Stages(docs.sparkSession, "simhash")
    texts = stages.keep(docs.select("doc_id", "text").mapInArrow(_prints(n), "doc_id long, print long"))
    linked = texts.where("doc_id IS NOT NULL")
    prints = stages.keep(linked.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # explicit parts, as each small row makes 64 variants
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() * 64 // PART)
    found = stages.keep(links(prints.select("print").repartition(parts), stages))
    ends = [prints.select(F.col("print").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab"]
    found = found.join(ends[0], "a").join(ends[1], "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    known = components(found, stages)
    placed = prints.join(known, F.col("rep") == F.col("node"), "left").select("print", "copies", F.coalesce("component", "rep").alias("component_id"))
    placed = stages.keep(placed)
    stages.only(texts, placed)
    rows = onto_rows(linked, placed, "print").unionByName(texts.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
