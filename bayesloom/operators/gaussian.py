"""Linear-Gaussian and conditional linear-Gaussian families: fit in one aggregation, densities, exact conditioning."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normal_log_density


class Linear(NamedTuple):
    """``child ~ N(intercept + sum of coef * parent, std)``."""

    child: str
    parents: list[str]
    intercept: float
    coef: list[float]
    std: float

    def mean(self) -> Column:
        out = F.lit(self.intercept)
        for p, c in zip(self.parents, self.coef, strict=True):
            out = out + F.lit(c) * F.col(p)
        return out

    def log_density(self) -> Column:
        return normal_log_density(F.col(self.child), self.mean(), F.lit(self.std))


def moments(df: DataFrame, columns: list[str], shift: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Count, sums and cross products of shifted columns: additive sufficient statistics of every family among them."""
    x = {c: F.col(c).cast("double") - F.lit(shift[c]) for c in columns}
    aggs = [F.count("*").alias("n"), *[F.sum(x[c]).alias(f"s_{c}") for c in columns]]
    aggs += [F.sum(x[a] * x[b]).alias(f"q_{a}__{b}") for i, a in enumerate(columns) for b in columns[i:]]
    rows = df.dropna(subset=[*columns, *(by or [])])
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def solve(stats: dict, child: str, parents: list[str], shift: dict[str, float], ridge: float = 1e-6, least: float = 1e-6) -> Linear:
    """Ridge regression from moments; the intercept is not penalised, the residual variance is over n - 1."""
    n = stats["n"]
    if not n:
        return Linear(child, parents, 0.0, [0.0] * len(parents), 1.0)

    def q(a: str, b: str) -> float:
        raw = stats.get(f"q_{a}__{b}", stats.get(f"q_{b}__{a}"))
        return raw - stats[f"s_{a}"] * stats[f"s_{b}"] / n

    mean = {c: shift[c] + stats[f"s_{c}"] / n for c in [child, *parents]}
    if not parents:
        return Linear(child, [], mean[child], [], max(float(np.sqrt(max(q(child, child), 0) / n)), least))
    gram = np.array([[q(a, b) for b in parents] for a in parents])
    cross = np.array([q(a, child) for a in parents])
    coef = np.linalg.solve(gram + ridge * np.eye(len(parents)), cross)
    rss = max(q(child, child) - 2 * coef @ cross + coef @ gram @ coef, 0)
    return Linear(child, parents, float(mean[child] - sum(c * mean[p] for c, p in zip(coef, parents, strict=True))), coef.tolist(), max(float(np.sqrt(rss / max(n - 1, 1))), least))


def fit_linear(df: DataFrame, families: dict[str, list[str]], ridge: float = 1e-6) -> dict[str, Linear]:
    """All linear-Gaussian families: one scan for the means, one for all centred moments."""
    columns = sorted({c for k, v in families.items() for c in [k, *v]})
    means = df.select(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    shift = {c: means[c] or 0.0 for c in columns}
    stats = moments(df, columns, shift).first().asDict()
    return {c: solve(stats, c, p, shift, ridge) for c, p in families.items()}


def fit_conditional(df: DataFrame, child: str, config: list[str], parents: list[str], ridge: float = 0.0, least: float = 1e-6) -> list[dict]:
    """A regression for each configuration of discrete parents, and the pooled one under a null configuration.

    The degrees of freedom are n - (p + 1), at least 1. Configurations are parameters of the model, not rows.
    """
    columns = [child, *parents]
    means = df.select(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    shift = {c: means[c] or 0.0 for c in columns}
    out = []
    for row in [*moments(df, columns, shift, config).collect(), moments(df, columns, shift).first()]:
        stats = row.asDict()
        fitted = solve(stats, child, parents, shift, ridge, least)
        n, p = stats["n"], len(parents)
        old = (n - 1) if parents else n
        std = max(fitted.std * float(np.sqrt(old / max(n - (p + 1), 1))), least)
        out.append({**{c: stats.get(c) for c in config}, "n": n, "intercept": fitted.intercept, "coef": fitted.coef, "std": std})
    return out


def joint(families: list[Linear]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Mean and covariance of a whole network, from its families in topological order."""
    names = [f.child for f in families]
    at = {c: i for i, c in enumerate(names)}
    mu, sigma = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for i, f in enumerate(families):
        w = np.zeros(len(names))
        for p, c in zip(f.parents, f.coef, strict=True):
            w[at[p]] = c
        mu[i] = f.intercept + w @ mu
        cov = sigma @ w
        sigma[i, :i] = sigma[:i, i] = cov[:i]
        sigma[i, i] = w @ cov + f.std**2
    return names, mu, sigma


def condition(queries: DataFrame, families: list[Linear], target: str, evidence: list[str], jitter: float = 1e-8) -> DataFrame:
    """``queries`` with the exact ``mean`` and ``std`` of the target given evidence columns, as one linear expression."""
    names, mu, sigma = joint(families)
    t, e = names.index(target), [names.index(v) for v in evidence]
    if not e:
        return queries.withColumn("mean", F.lit(float(mu[t]))).withColumn("std", F.lit(float(np.sqrt(sigma[t, t]))))
    gain = np.linalg.solve(sigma[np.ix_(e, e)] + jitter * np.eye(len(e)), sigma[e, t])
    mean = F.lit(float(mu[t]))
    for v, i, g in zip(evidence, e, gain, strict=True):
        mean = mean + F.lit(float(g)) * (F.col(v) - F.lit(float(mu[i])))
    var = max(float(sigma[t, t] - gain @ sigma[e, t]), 0.0)
    return queries.withColumn("mean", mean).withColumn("std", F.lit(var**0.5))


def density_grid(rows: DataFrame, mean: Column, std: Column, points: int = 512, width: float = 4.0) -> DataFrame:
    """Each row with ``points`` values over mean +- width * std and their density."""
    z = F.lit(-width) + F.col("point") * F.lit(2 * width / max(points - 1, 1))
    out = rows.withColumn("_m", mean).withColumn("_s", std).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = out.withColumn("value", F.col("_m") + z * F.col("_s"))
    return out.withColumn("density", F.exp(normal_log_density(F.col("value"), F.col("_m"), F.col("_s")))).drop("_m", "_s")
