"""Random-feature Gaussian regression: partial Gram matrices in tasks, summed by Spark, one small solve.

The child's mean is linear in random cosines of the standardised parents. Every task adds up one
matrix of a size that only the number of features decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions.scalars import normal_log_density


class RandomFeatures(NamedTuple):
    """``child ~ N(mean_y + std_y * features(parents) @ weights, std)``."""

    child: str
    parents: list[str]
    center: np.ndarray
    spread: np.ndarray
    axes: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    std: float

    def mean_of(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center[1:]) / self.spread[1:]
        return self.center[0] + self.spread[0] * (_expand(z, self.axes, self.phase) @ self.weights)

    def log_density(self, mean: str = "mean") -> Column:
        return normal_log_density(F.col(self.child), F.col(mean), F.lit(self.std))


def _expand(z: np.ndarray, axes: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random cosines and a constant."""
    return np.column_stack((np.sqrt(2 / len(phase)) * np.cos(z @ axes + phase), np.ones(len(z))))


def _matrix(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]).astype(float)


def fit(df: DataFrame, child: str, parents: list[str], features: int = 64, length_scale: float = 1.0, ridge: float = 1e-3, seed: int = 0, least: float = 1e-6) -> RandomFeatures:
    """Ridge regression on the features (the constant is penalised too), population variance of the residuals.

    Rows with nulls are left out; without rows the mean is 0 and the standard deviation 1.
    """
    columns = [child, *parents]
    rows = df.dropna(subset=columns).select(*[F.col(c).cast("double").alias(c) for c in columns])
    got = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((len(parents), features)) / length_scale
    phase = rng.uniform(0, 2 * np.pi, features)
    if not got["n"]:
        return RandomFeatures(child, list(parents), np.zeros(len(columns)), np.ones(len(columns)), axes, phase, np.zeros(features + 1), 1.0)
    center = np.array([got[f"m_{i}"] for i in range(len(columns))])
    spread = np.array([max(got[f"s_{i}"], least) for i in range(len(columns))])
    width = features + 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            z = (_matrix(batch, len(columns)) - center) / spread
            a = np.column_stack((_expand(z[:, 1:], axes, phase), z[:, 0]))
            total += a.T @ a
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], names=["at", "x"])

    cells = rows.mapInArrow(task, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # width * width rows
    gram = np.zeros(width * width)
    gram[cells.column("at").to_numpy()] = cells.column("x").to_numpy()
    gram = gram.reshape(width, width)
    inner, cross = gram[:-1, :-1], gram[:-1, -1]
    weights = np.linalg.solve(inner + ridge * np.eye(width - 1), cross)
    rss = max(gram[-1, -1] - 2 * weights @ cross + weights @ inner @ weights, 0.0)
    return RandomFeatures(child, list(parents), center, spread, axes, phase, weights, max(float(np.sqrt(rss / got["n"]) * spread[0]), least))


def predict(df: DataFrame, model: RandomFeatures, mean: str = "mean") -> DataFrame:
    """``df`` with the child's mean given its parents; null where a parent is null."""
    at = [df.columns.index(p) for p in model.parents]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in at])
            m = model.mean_of(x)
            yield batch.append_column(mean, pa.array(m, mask=np.isnan(m)))

    return df.mapInArrow(task, StructType([*df.schema.fields]).add(mean, DoubleType()))
