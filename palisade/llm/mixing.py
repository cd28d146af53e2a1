"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources are ordered by code point, null last, and get the given weights in
turn. The budget is a share of all words. A source's target is its weight's
share of the budget, clamped at ``max_epochs`` times its size; what is clamped
off goes to the others by weight until none is above its clamp. With sources
sorted by clamp/weight, the clamped ones are a prefix, and two running sums give
the level that each prefix would leave for the others. Prefixes that are too short
leave a level above the next clamp, longer ones than needed a lower level: the
largest level that is not above the next clamp is the one sought.

A source's documents are taken ``floor(target/size)`` times each; the rest of
the target is filled with one more repetition of documents in the order of a
seeded hash. Bins of that hash are summed first, so only the one bin in which
the rest runs out is ordered document by document, and each source has one
cut-off key: a row's repetitions need no join on documents.

Defined cases: null text has size 0; a source of size 0 has target 0; rows with
equal doc_id share the same fate; null doc_id is an id of its own; an empty
table gives an empty result; extra columns are kept by ``mixed`` and ignored by
``plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.store import Stages

WORD = r"[^\x20\x09-\x0D]+"
FEW = 50_000  # sources whose rules may be broadcast
BIN = 3  # hexadecimal digits of the hash: 4096 bins a source


def _key(seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _size() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", _size().alias("size"), _key(seed).alias("key"))


def few(rule: DataFrame) -> DataFrame:
    """``rule``, to be broadcast if it has few sources; a join with more of them shuffles."""
    return F.broadcast(rule) if rule.count() <= FEW else rule


def targets(sized: DataFrame, weights: tuple[int, ...], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """source, source_size, target: one row for each source. ``share`` is (percent points, 100) of all words."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    every = Window.partitionBy()
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    up_to, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        by_source.withColumn("weight", weight)
        .withColumn("clamp", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("clamp") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share[0]))
        .withColumn("clamped", F.coalesce(F.sum("clamp").over(up_to), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("try", (F.col("budget") - F.col("clamped") * share[1]) / (F.col("open") * share[1]))
        .withColumn("water", F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(every))
    )
    clamp = F.col("clamp").cast("double")
    return filled.select("source", "source_size", F.least(clamp, F.coalesce(F.col("water") * F.col("weight"), clamp)).alias("target"))


def cutoffs(sized: DataFrame, target: DataFrame) -> DataFrame:
    """One row for each source: its target, whole repetitions and the last key that gets one more."""
    rule = target.select(
        F.col("source").alias("rule_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole"),
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    same = F.col("source").eqNullSafe(F.col("rule_source"))
    bins = sized.groupBy("source", F.substring("key", 1, BIN).alias("bin")).agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
        .join(rule, same)
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bin_size")))
        .select("source", "bin", "before", "rest")
    )
    at = last.select(F.col("source").alias("at_source"), F.col("bin").alias("at_bin"), "before", "rest")
    inside = (
        sized.join(at, F.col("source").eqNullSafe(F.col("at_source")) & (F.substring("key", 1, BIN) == F.col("at_bin")))
        .groupBy("source", "key", "before", "rest")
        .agg(F.sum("size").alias("key_size"))
    )
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("before") + F.coalesce(F.sum("key_size").over(running), F.lit(0)) + F.col("key_size") / 2 <= F.col("rest")
    ends = inside.withColumn("in", taken).groupBy("source").agg(F.max(F.when(F.col("in"), F.col("key"))).alias("last_key"))
    ends = last.join(ends.withColumnRenamed("source", "end_source"), F.col("source").eqNullSafe(F.col("end_source")), "left")
    ends = ends.select(F.col("source").alias("end_source"), F.coalesce("last_key", "bin").alias("last_key"))
    return rule.join(ends, F.col("rule_source").eqNullSafe(F.col("end_source")), "left").select(
        "rule_source", "source_size", "target", "whole", F.when(F.col("rest") > 0, F.coalesce("last_key", F.lit(""))).otherwise("").alias("last_key")
    )


def plan(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (150, 100), max_epochs: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken: one row for each row of ``docs``."""
    stages = Stages(docs.sparkSession, "mixing")
    sized = stages.keep(sizes(docs, seed))
    rule = few(stages.keep(cutoffs(sized, targets(sized, weights, share, max_epochs))))
    times = F.col("whole") + (F.col("key") <= F.col("last_key")).cast("int")
    return sized.join(rule, F.col("source").eqNullSafe(F.col("rule_source"))).select(
        "doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken")
    )


def mixed(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (150, 100), max_epochs: int = 2) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    stages = Stages(docs.sparkSession, "mixing")
    sized = stages.keep(sizes(docs, seed))
    rule = stages.keep(cutoffs(sized, targets(sized, weights, share, max_epochs)))
    stages.drop(sized)
    rule = few(rule).select(F.col("rule_source").alias("__source"), F.col("whole").alias("__whole"), F.col("last_key").alias("__last"))
    times = F.col("__whole") + (_key(seed) <= F.col("__last")).cast("int")
    joined = docs.join(rule, docs["source"].eqNullSafe(F.col("__source")))
    repeated = joined.withColumn("__times", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])
