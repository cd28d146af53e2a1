"""Vectors of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(vectors: DataFrame, column: str = "embedding") -> int:
    """The length that most vectors have, the least of several; 0 without vectors."""
    found = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("length")).count()
    first = found.orderBy(F.desc("count"), "length").first()
    return first["length"] if first else 0


def finite(batch: pa.RecordBatch, size: int, at: int = 1) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows whose vector in column ``at`` has ``size`` components, all finite, and these vectors in double precision."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column(at)), size), False)
    batch = batch.filter(fits)
    values = pc.fill_null(batch.column(at).flatten().cast(pa.float64()), float("nan"))
    x = values.to_numpy(zero_copy_only=False).reshape(-1, size)
    ok = np.isfinite(x).all(1)
    return batch.filter(pa.array(ok)), x[ok]
