"""Scores of a small multilayer perceptron over numeric and categorical features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Layers = list[tuple[np.ndarray, np.ndarray]]


def scaling(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of each column, from one aggregation; the result is one row."""
    one = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (one[f"m_{c}"] or 0.0, one[f"s_{c}"] or 1.0) for c in columns}


def vector(columns: list[str], scales: dict[str, tuple[float, float]], categories: dict[str, list[str]]) -> Column:
    """The model's input: scaled numbers, then one-hot categories; unknown categories are all 0."""
    numbers = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(scales[c][0])) / F.lit(scales[c][1]) for c in columns]
    hot = [(F.coalesce(F.col(c), F.lit("")) == v).cast("double") for c, values in categories.items() for v in values]
    return F.array(*numbers, *hot)


def perceptron(features: Column, layers: Layers) -> Column:
    """Forward pass in Arrow batches: rectified hidden layers, logistic output, six digits."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        h = np.stack(x.to_numpy()) if len(x) else np.zeros((0, layers[0][0].shape[0]))
        for weights, bias in layers[:-1]:
            h = np.maximum(h @ weights + bias, 0)
        weights, bias = layers[-1]
        return pd.Series(np.round(1 / (1 + np.exp(-(h @ weights + bias)[:, 0])), 6))

    return score(features)
