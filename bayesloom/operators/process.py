"""Exact Gaussian-process nodes: bounded points for each node, all nodes fitted side by side by key.

A node's points are a sample that merges (``kernel.sample``), its bound a parameter of the method. Hyperparameters climb the
marginal likelihood by its exact gradient; the Cholesky factor and the weights of the points are kept as a row of a table, and
predictions are matrix products in Arrow tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions.draws import normal
from ..functions.scalars import normal_log_density
from . import kernel as points_of

SCHEMA = "node string, kernel string, n int, centre array<double>, spread array<double>, log_length double, log_signal double, log_noise double, likelihood double, points array<double>, factor array<double>, weights array<double>"


def covariance(kind: str, r: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Correlation at distance ``r``, and its derivative in the logarithm of the length."""
    s = r / length
    if kind == "rbf":
        k = np.exp(-0.5 * s * s)
        return k, k * s * s
    if kind == "matern32":
        a = math.sqrt(3) * s
        return (1 + a) * np.exp(-a), a * a * np.exp(-a)
    if kind == "matern52":
        a = math.sqrt(5) * s
        return (1 + a + a * a / 3) * np.exp(-a), a * a * (1 + a) / 3 * np.exp(-a)
    raise ValueError(f"unknown kernel {kind!r}; there are ['matern32', 'matern52', 'rbf']")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def likelihood(kind: str, r: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log marginal likelihood, its gradient in (log length, log signal, log noise), the lower Cholesky factor, and the points' weights."""
    length, signal, noise = np.exp(theta)
    k, dk = covariance(kind, r, length)
    c = signal**2 * k + (noise**2 + 1e-10) * np.eye(len(y))
    low = np.linalg.cholesky(c)
    half = np.linalg.solve(low, np.eye(len(y)))
    inverse = half.T @ half
    alpha = inverse @ y
    value = -0.5 * y @ alpha - np.log(np.diag(low)).sum() - 0.5 * len(y) * math.log(2 * math.pi)
    inner = np.outer(alpha, alpha) - inverse
    gradient = np.array([0.5 * (inner * (signal**2 * dk)).sum(), (inner * (signal**2 * k)).sum(), noise**2 * np.trace(inner)])
    return float(value), gradient, low, alpha


def climb(kind: str, x: np.ndarray, y: np.ndarray, steps: int, rate: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Steps uphill by sign and size of the gradient, halved where one would lead down; a step that does not help any more ends it."""
    r = _distances(x, x)
    theta = np.array([0.0, 0.0, math.log(0.3)])
    value, gradient, low, alpha = likelihood(kind, r, y, theta)
    for _ in range(steps):
        step = rate * gradient / max(np.abs(gradient).max(), 1e-12) * 5
        for _ in range(12):
            try:
                new = likelihood(kind, r, y, np.clip(theta + step, -8, 8))
            except np.linalg.LinAlgError:
                new = (-math.inf, None, None, None)
            if new[0] > value:
                break
            step = step / 2
        else:
            break
        theta = np.clip(theta + step, -8, 8)
        done = new[0] - value < 1e-7 * abs(value)
        value, gradient, low, alpha = new
        if done:
            break
    return theta, value, low, alpha


def fit_nodes(df: DataFrame, families: dict[str, list[str]], kind: str = "rbf", max_points: int = 200, steps: int = 40, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """A row for each node: its points, hyperparameters, Cholesky factor and weights. Nodes are fitted in parallel, by key.

    Rows with a null in a family are left out of it; a node without rows has no points, mean 0 and spread 1.
    """
    covariance(kind, np.zeros(1), 1.0)
    nodes = None
    for v, p in families.items():
        drawn = points_of.sample(df, [v, *p], max_points, seed)
        one = drawn.select(F.lit(v).alias("node"), "order_key", F.array(v, *p).alias("row"))
        nodes = one if nodes is None else nodes.unionByName(one)
    if nodes is None:
        raise ValueError("there are no nodes")
    empty = df.sparkSession.createDataFrame([(v,) for v in families], "node string").select("node", F.lit(None).cast("double").alias("order_key"), F.lit(None).cast("array<double>").alias("row"))
    nodes = nodes.unionByName(empty)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        node = frame["node"].iloc[0]
        rows = frame[frame["row"].notna()].sort_values("order_key")
        p = len(families[node])
        data = np.array(rows["row"].tolist(), dtype=float).reshape(len(rows), p + 1)
        centre = data.mean(axis=0) if len(data) else np.zeros(p + 1)
        spread = np.maximum(data.std(axis=0), 1e-6) if len(data) else np.ones(p + 1)
        z = (data - centre) / spread
        x, y = (z[:, 1:] if p else np.zeros((len(z), 1))), z[:, 0]
        if len(z):
            theta, value, low, alpha = climb(kind, x, y, steps, rate)
        else:
            theta, value, low, alpha = np.zeros(3), 0.0, np.zeros((0, 0)), np.zeros(0)
        return pd.DataFrame([(node, kind, len(z), centre.tolist(), spread.tolist(), *theta, value, x.ravel().tolist(), low.ravel().tolist(), alpha.tolist())], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return nodes.groupBy("node").applyInPandas(fit, SCHEMA)


class Predictor:
    """One node's parameters, as arrays: what a prediction task gets, of at most ``max_points`` squared numbers."""

    def __init__(self, row: Row):
        self.kind, self.n = row.kernel, row.n
        self.centre, self.spread = np.array(row.centre), np.array(row.spread)
        self.length, self.signal, self.noise = (math.exp(t) for t in (row.log_length, row.log_signal, row.log_noise))
        self.x = np.array(row.points).reshape(row.n, -1) if row.n else np.zeros((0, 1))
        self.low, self.alpha = np.array(row.factor).reshape(row.n, row.n), np.array(row.weights)

    def __call__(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and spread of the child (with its noise) at rows of parents' values."""
        if not self.n:
            return np.zeros(len(at)), np.ones(len(at))
        z = (at - self.centre[1:]) / self.spread[1:] if len(self.centre) > 1 else np.zeros((len(at), 1))
        k = self.signal**2 * covariance(self.kind, _distances(z, self.x), self.length)[0]
        v = np.linalg.solve(self.low, k.T)
        variance = np.maximum(self.signal**2 - (v * v).sum(axis=0), 0) + self.noise**2
        return self.centre[0] + self.spread[0] * (k @ self.alpha), self.spread[0] * np.sqrt(np.maximum(variance, 1e-12))


@dataclass
class Process:
    """A fitted node: the row of its parameters."""

    child: str
    parents: list[str]
    table: DataFrame
    family = "gaussian_process"

    def __post_init__(self) -> None:
        self.row = self.table.where(F.col("node") == self.child).first()
        self.predictor = Predictor(self.row)

    def with_params(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_mean`` and ``_std``; null where a parent is null."""
        parents, predict = list(self.parents), self.predictor

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                at = np.column_stack([batch.column(batch.schema.get_field_index(p)).cast(pa.float64()).to_numpy(zero_copy_only=False) for p in parents]) if parents else np.zeros((batch.num_rows, 1))
                parts = [predict(at[i : i + 4096]) for i in range(0, len(at), 4096)] or [(np.zeros(0), np.zeros(0))]
                mean, std = (np.concatenate(x) for x in zip(*parts, strict=True))
                bad = np.isnan(mean)
                yield batch.append_column("_mean", pa.array(mean, mask=bad)).append_column("_std", pa.array(std, mask=bad))

        return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("_mean", DoubleType()).add("_std", DoubleType()))

    def draw(self, rows: DataFrame, seed: int, keys: list[str]) -> DataFrame:
        return self.with_params(rows).withColumn(self.child, F.col("_mean") + F.col("_std") * normal(F.lit(seed), *keys, F.lit(self.child))).drop("_mean", "_std")

    def log_prob(self, rows: DataFrame) -> DataFrame:
        return self.with_params(rows).withColumn("log_prob", normal_log_density(F.col(self.child).cast("double"), F.col("_mean"), F.col("_std"))).drop("_mean", "_std")

    def size(self) -> dict:
        return {"points": self.row.n, "likelihood": self.row.likelihood}
