"""Confusion counts and metrics of scores against the truth, and the search for a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """Metrics from tp, fp, tn, fn; ratios without a denominator are 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "fpr": _ratio(fp, fp + tn), "tnr": _ratio(tn, tn + fp)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1": _ratio(2 * p * r, p + r), "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "youden_j": r + F.col("tnr") - 1})


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    hit, attack = F.col("score") >= threshold, F.col("is_attack") == 1
    return metrics(rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", hit & attack), ("fp", hit & ~attack), ("tn", ~hit & ~attack), ("fn", ~hit & attack))]))


def sweep(rows: DataFrame, low: int = 5, high: int = 95) -> DataFrame:
    """Metrics for the thresholds low/100 ... high/100, from one pass over the rows.

    A row counts in the bucket of the greatest threshold it reaches; the buckets,
    about a hundred, are then summed from above. No row meets more than one threshold.
    """
    steps = F.array(*[F.lit(i / 100.0) for i in range(low, high + 1)])
    near = F.least(F.greatest(F.floor(F.col("score") * 100).cast("int"), F.lit(low - 1)), F.lit(high))
    # the product may be off by a rounding: compare with the thresholds beside it
    at = lambda i: F.try_element_at(steps, (i - low + 1).cast("int"))
    reached = F.when(F.col("score").isNull(), low - 1).when(near < low, F.when(F.col("score") >= low / 100.0, low).otherwise(low - 1))
    reached = reached.when(at(near) > F.col("score"), near - 1).when((near < high) & (at(F.least(near + 1, F.lit(high))) <= F.col("score")), near + 1).otherwise(near)
    by_bucket = rows.groupBy(reached.alias("i")).agg(F.count_if(F.col("is_attack") == 1).alias("p"), F.count_if(F.col("is_attack") != 1).alias("n"))
    spine = rows.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("i"))
    full = spine.join(by_bucket, "i", "left").fillna(0, ["p", "n"])
    above, all_ = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    counts = full.select(
        "i", F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"),
        (F.sum("n").over(all_) - F.sum("n").over(above)).alias("tn"), (F.sum("p").over(all_) - F.sum("p").over(above)).alias("fn"),
    )
    return metrics(counts.where(F.col("i") >= low)).withColumn("threshold", F.col("i") / 100.0).drop("i")


def best(swept: DataFrame) -> DataFrame:
    """The threshold with the best accuracy, then f1, precision, false-positive rate, recall; the lowest of equals."""
    order = [F.desc("accuracy"), F.desc("f1"), F.desc("precision"), F.asc("fpr"), F.desc("recall"), F.asc("threshold")]
    return swept.orderBy(*order).limit(1)


def coverage(truth: DataFrame, scores: DataFrame, key: str = "seq_id") -> DataFrame:
    """How many of the expected rows were scored."""
    joined = truth.select(key).join(scores.select(key).distinct().withColumn("scored", F.lit(1)), key, "left")
    one = joined.agg(F.count("*").alias("expected"), F.count("scored").alias("scored"))
    return one.withColumn("coverage", _ratio(F.col("scored"), F.col("expected")))


def by_trace(index: DataFrame, truth: DataFrame, scores: DataFrame) -> DataFrame:
    """Truth rows met by the trace id inside a request's uri, then by the scored sequence."""
    traced = index.withColumn("trace", F.regexp_extract("uri", r"(bench[A-Za-z]*_\d{4})", 1)).where("trace <> ''")
    return traced.join(truth, "trace").join(scores, "seq_id").select("seq_id", "trace", "is_attack", "score")
