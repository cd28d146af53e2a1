"""Rank and scale scores in each file, choose candidates and look up their requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["file_id", "seq_id"]


def label_scores(scores: DataFrame, threshold: float = 0.46) -> DataFrame:
    return scores.withColumn("label", F.when(F.col("score") >= threshold, "suspicious").otherwise("benign"))


def candidate_score(*columns: Column) -> Column:
    """The first that is a number, in the order given (raw score, score, scaled score); 0 where none is."""
    return F.coalesce(*[c.try_cast("double") for c in columns], F.lit(0.0))


def rerank(scores: DataFrame) -> DataFrame:
    """Rank by falling score in each file, ties in input order, and min-max scaled scores (0 where all are equal).

    The scale needs two numbers a file: they are aggregated and joined, so the
    only sort is the ranking's own.
    """
    score = F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))
    raw = scores.withColumn("raw_score", score)
    ends = raw.groupBy("file_id").agg(F.min("raw_score").alias("low"), F.max("raw_score").alias("high"))
    order = Window.partitionBy("file_id").orderBy(F.desc("raw_score"), "seq_id")
    span = F.col("high") - F.col("low")
    norm = F.when(span > 1e-12, F.round((F.col("raw_score") - F.col("low")) / span, 6)).otherwise(0.0)
    return raw.join(ends, "file_id").select(*KEY, "raw_score", norm.alias("norm_score"), F.row_number().over(order).alias("rank"))


def top_candidates(ranked: DataFrame, k: int) -> DataFrame:
    """The first k of each file; rows without a rank come last."""
    order = Window.partitionBy("file_id").orderBy(F.coalesce("rank", F.lit(10**9)), "seq_id")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(k, 0)).drop("place")


def with_requests(candidates: DataFrame, parsed: DataFrame, model_input: DataFrame, columns: list[str]) -> DataFrame:
    """Each column from the parsed row where there is one, even if it is null there; else from the model's input."""
    p = parsed.select(*KEY, F.lit(True).alias("p_here"), *[F.col(c).alias(f"p_{c}") for c in columns])
    m = model_input.select(*KEY, *[F.col(c).alias(f"m_{c}") for c in columns])
    joined = candidates.join(p, KEY, "left").join(m, KEY, "left")
    return joined.select(*candidates.columns, *[F.when(F.col("p_here"), F.col(f"p_{c}")).otherwise(F.col(f"m_{c}")).alias(c) for c in columns])


def merged(*sources: DataFrame) -> DataFrame:
    """All keys of all sources; a later source's columns replace an earlier one's where it has the key, null or not."""
    out = None
    for i, source in enumerate(sources):
        s = source.withColumn(f"here{i}", F.lit(True))
        if out is None:
            out = s
            continue
        both = [c for c in s.columns if c in out.columns and c not in KEY]
        s = s.withColumnsRenamed({c: f"new_{c}" for c in both})
        out = out.join(s, KEY, "full_outer")
        out = out.withColumns({c: F.when(F.col(f"here{i}"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in both}).drop(*[f"new_{c}" for c in both])
    return out.drop(*[f"here{i}" for i in range(len(sources))])


def micro_batches(pairs: DataFrame, size: int) -> DataFrame:
    """Number the pairs of each file in batches of ``size``; an incomplete last batch is held back."""
    order = Window.partitionBy("file_id").orderBy("seq_id")
    numbered = pairs.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size))
    full = numbered.groupBy("file_id", "batch").count().where(F.col("count") == size).select("file_id", "batch")
    return numbered.join(full, ["file_id", "batch"], "left_semi")
