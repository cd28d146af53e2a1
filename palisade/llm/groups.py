"""Values of groups for each of their rows, where one group may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGE, SHARE = 1000, 10_000  # groups of more rows than LARGE and than one in SHARE of all rows are broadcast: fewer than SHARE groups


def onto_rows(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with the other columns of ``groups``, which has a row for each ``key`` (null is a key as well) and counts its rows in ``copies``.

    Rows of large groups stay where they are, so that no task gets a whole group; the
    others, none of which is large, meet their group by a shuffle.
    """
    total = groups.agg(F.sum("copies")).first()[0] or 0
    groups = groups.withColumnRenamed(key, "_key")
    large, same = F.col("copies") > max(LARGE, total // SHARE), F.col(key).eqNullSafe(F.col("_key"))
    few = F.broadcast(groups.where(large))
    parts = rows.join(few, same), rows.join(few, same, "left_anti").join(groups.where(~large), same)
    return reduce(DataFrame.unionByName, [p.drop("_key", "copies") for p in parts])
