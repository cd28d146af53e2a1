"""Connected components of links between integer ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.store import Stages


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node hangs its greater neighbours on its least one. The minimum is taken before the shuffle, so hubs stay cheap."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b")


def _small(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its lesser neighbours on the least of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return hung.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """node, component for each id in ``links`` (a, b); component is the least id of the component.

    Every round is written and read again. A round at least halves the depth of the trees,
    so their number is logarithmic in the diameter.
    """
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = stages.keep(links.where("a <> b").select(low, high).distinct())
    mark = _mark(edges)
    while True:
        after = stages.keep(_small(_large(edges).distinct()).distinct())
        stages.drop(edges)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
