"""Elastic net from one pass over the rows.

The objective (1/2n)|y - Xw|^2 + a r |w|_1 + a (1-r)/2 |w|^2 depends on the rows only
through the cross-product matrix. Tasks sum it per Arrow batch, Spark adds the partial rows,
and every candidate is solved from the same matrix instead of one job per candidate.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basic import finite
from ..functions.predictors import PredictorPolicy
from .encode import Encoder, fit_encoder

# Candidate grid of the blocked selection.
ALPHAS = (0.001, 0.01, 0.1, 1.0)
L1_RATIOS = (0.0, 0.25, 0.5, 0.75, 1.0)


def cross_products(df: DataFrame, width: int, features: str = "x", label: str = "y") -> np.ndarray:
    """Sum of z z' with z = (1, x, y), as a (width + 2)-square matrix."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 2, width + 2))
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), np.stack(pdf[features].to_numpy()), pdf[label].to_numpy()])
            total += z.T @ z
        yield pd.DataFrame({"i": range(width + 2), "row": list(total)})

    parts = df.select(features, label).mapInPandas(partial, "i int, row array<double>")
    summed = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    # As many rows as features, whatever the table size.
    rows = summed.select("i", vector_to_array("row").alias("row")).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def solve(matrix: np.ndarray, alpha: float, l1_ratio: float, tolerance: float = 1e-10, sweeps: int = 20_000):
    """Coordinate descent on the centred cross-products: ``(intercept, coefficients)``."""
    n = matrix[0, 0]
    mean = matrix[0, 1:] / n
    centred = matrix[1:, 1:] / n - np.outer(mean, mean)
    gram, target = centred[:-1, :-1], centred[:-1, -1]
    w = np.zeros(len(target))
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 1e-14:
                continue
            pull = target[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha * l1_ratio, 0.0) / (gram[j, j] + alpha * (1.0 - l1_ratio))
            largest = max(largest, abs(new - w[j]))
            w[j] = new
        if largest < tolerance:
            break
    return float(mean[-1] - mean[:-1] @ w), w


@dataclass(frozen=True)
class LinearFit:
    """Encoder and coefficients; prediction is one native expression."""

    encoder: Encoder
    intercept: float
    coefficients: tuple[float, ...]
    alpha: float
    l1_ratio: float

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        value = F.lit(self.intercept)
        for w, x in zip(self.coefficients, self.encoder.feature_columns().values(), strict=True):
            if w:
                value = value + F.lit(w) * x
        return df.withColumn(output, value)


def fit_elastic_net(
    train: DataFrame, label: str, policy: PredictorPolicy, predictors: Sequence[str],
    alpha: float = 0.01, l1_ratio: float = 0.5,
) -> LinearFit:
    encoder = fit_encoder(train, policy, predictors=predictors, kind="linear")
    rows = encoder.with_array(train.withColumn("y", finite(label)).filter("y is not null"))
    intercept, w = solve(cross_products(rows, len(encoder.feature_names)), alpha, l1_ratio)
    return LinearFit(encoder, intercept, tuple(float(v) for v in w), alpha, l1_ratio)


def candidate_scores(
    train: DataFrame, validation: DataFrame, label: str, policy: PredictorPolicy, predictors: Sequence[str],
    block: Sequence[str], alphas: Sequence[float] = ALPHAS, l1_ratios: Sequence[float] = L1_RATIOS,
) -> list[tuple[float, float, float]]:
    """``(alpha, l1_ratio, grouped MAE)`` of the whole grid: one pass over each side."""
    encoder = fit_encoder(train, policy, predictors=predictors, kind="linear")
    rows = encoder.with_array(train.withColumn("y", finite(label)).filter("y is not null"))
    matrix = cross_products(rows, len(encoder.feature_names))
    grid = [(a, r) for a in alphas for r in l1_ratios]
    fits = [solve(matrix, a, r) for a, r in grid]
    intercepts = np.array([f[0] for f in fits])
    weights = np.column_stack([f[1] for f in fits])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fitted = np.stack(pdf["x"].to_numpy()) @ weights + intercepts
            yield pdf[list(block)].assign(e=list(np.abs(fitted - pdf["y"].to_numpy()[:, None])))

    held = encoder.with_array(validation.withColumn("y", finite(label)).filter("y is not null"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.select(*block).schema)
    scored = held.select(*block, "x", "y").mapInPandas(errors, f"{kinds}, e array<double>")
    per_block = scored.groupBy(*block).agg(*[F.avg(F.col("e")[i]).alias(f"e{i}") for i in range(len(grid))])
    means = per_block.agg(*[F.avg(f"e{i}").alias(f"e{i}") for i in range(len(grid))]).first()
    return [(a, r, means[f"e{i}"]) for i, (a, r) in enumerate(grid)]
