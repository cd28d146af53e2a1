"""Steps that depend on the one before them, and the first rows of an order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 1024


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[tuple], object], step: Callable[[object, tuple], object], end: Callable[[object], tuple], schema: str) -> DataFrame:
    """One row of ``schema`` for each ``key``: ``end`` of a state that ``start`` makes of the key's first row and ``step`` takes through all its rows, in ``order``.

    Rows are sorted in their partition and go by one at a time, so a key of any length needs the memory of its state.
    """
    names = [p.split()[0] for p in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, out = None, None, []
        for f in frames:
            at = f.columns.get_loc(key)
            for r in f.itertuples(index=False):
                if last is None or r[at] != last[0]:
                    if last is not None:
                        out.append(end(state))
                    last, state = (r[at],), start(r)
                state = step(state, r)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if last is not None:
            out.append(end(state))
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def first_by(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The ``most`` rows with the least values of an integer ``column`` without equal values, by counts of blocks of values and without a sort.

    Each round counts at most ``BLOCKS`` blocks and goes on inside the one in which the rows run out.
    """
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or n <= most:
        return rows.where(F.col(column).isNotNull())
    left = most
    while high > low:
        wide = -(-(high - low + 1) // BLOCKS)
        block = F.floor((F.col(column) - low) / wide)
        counts = dict(rows.where(F.col(column).between(low, high)).groupBy(block.cast("long").alias("b")).count().collect())
        for b in sorted(counts):
            if counts[b] > left:
                low, high = low + b * wide, min(high, low + (b + 1) * wide - 1)
                break
            left -= counts[b]
            if not left:
                return rows.where(F.col(column) < low + (b + 1) * wide)
    return rows.where(F.col(column) <= low if left else F.col(column) < low)
