"""The most frequent keys of a table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINE = 8  # levels for each doubling of a count


PARTS = 4096  # of a level that holds too many rows


def _within(counts: DataFrame, key: Column, left: int) -> tuple[int | None, int]:
    """The lowest value of ``key`` from which on rows are at most ``left``, and how many these are."""
    low = None
    for row in sorted(counts.groupBy(key.alias("key")).count().collect(), key=lambda r: -r["key"]):
        if row["count"] > left:
            break
        left, low = left - row["count"], row["key"]
    return low, left


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """Rows of ``counts`` with the greatest values of ``column``, at most ``most`` and few less: whole levels of values, and of the next level parts by a hash of the row.

    Only the numbers of rows of each level and of each part of one level, a few thousand, come to the driver, so
    no task sends it a list of its own. Equal rows are taken together.
    """
    level, part = F.floor(F.log2(F.col(column)) * FINE), F.pmod(F.xxhash64(*counts.columns), F.lit(PARTS))
    low, left = _within(counts, level, most)
    above = level >= low if low is not None else F.lit(False)
    top = counts.where(~above).agg(F.max(level)).first()[0]
    if top is None or not left:
        return counts.where(above)
    first, _ = _within(counts.where(level == top), part, left)
    return counts.where(above | ((level == top) & (part >= first)) if first is not None else above)
