"""Divergences of probability arrays, as expressions that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def validated(p: Column) -> Column:
    """The array as probabilities, renormalised where its sum is off by more than 1e-6; null where it has none."""
    q = F.transform(p, lambda v: v.cast("double"))
    fine = F.forall(q, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v >= -1e-12))
    total = _sum(q)
    return F.when(p.isNotNull() & (F.size(p) > 0) & fine & (total > 0), F.when(F.abs(total - 1) > 1e-6, F.transform(q, lambda v: v / total)).otherwise(q))


def clipped(p: Column, eps: float = EPS) -> Column:
    """Clipped to [eps, 1] and normalised; uniform where nothing is left."""
    q = F.transform(p, lambda v: F.greatest(F.least(v, F.lit(1.0)), F.lit(eps)))
    total = _sum(q)
    return F.when(total > 0, F.transform(q, lambda v: v / total)).otherwise(F.transform(q, lambda v: 1.0 / F.size(q)))


def kl(p: Column, q: Column, eps: float = EPS) -> Column:
    """Kullback-Leibler divergence in nats, both sides clipped."""
    return _sum(F.zip_with(clipped(p, eps), clipped(q, eps), lambda a, b: a * F.ln(a / b)))


def jsd(p: Column, q: Column, normalised: bool = False) -> Column:
    """Jensen-Shannon divergence in nats, or over ln 2."""

    def half(a: Column, m: Column) -> Column:
        return F.when((a > 0) & (m > 0), a * F.ln(a / m)).otherwise(0.0)

    d = 0.5 * _sum(F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2)))
    return d / math.log(2) if normalised else d


def wasserstein(p: Column, q: Column) -> Column:
    """Wasserstein-1 distance of two pmfs on equally spaced values one apart."""
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("total"))

    def step(a: Column, d: Column) -> Column:
        return F.struct((a["gap"] + d).alias("gap"), (a["total"] + F.abs(a["gap"] + d)).alias("total"))

    return F.aggregate(F.zip_with(p, q, lambda a, b: a - b), start, step, lambda a: a["total"])


def wasserstein_on(p: Column, q: Column, support: Column) -> Column:
    """Wasserstein-1 distance of two pmfs on an increasing support: the gap of the distribution functions times the step to the next value."""
    steps = F.transform(F.sequence(F.lit(1), F.size(support) - 1), lambda i: F.element_at(support, i + 1) - F.element_at(support, i))
    start = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("total"))

    def step(a: Column, x: Column) -> Column:
        return F.struct((a["gap"] + x["d"]).alias("gap"), (a["total"] + F.abs(a["gap"] + x["d"]) * x["w"]).alias("total"))

    both = F.zip_with(F.slice(F.zip_with(p, q, lambda a, b: a - b), F.lit(1), F.size(support) - 1), steps, lambda d, w: F.struct(d.alias("d"), w.alias("w")))
    return F.when(F.size(support) > 1, F.aggregate(both, start, step, lambda a: a["total"])).otherwise(F.lit(0.0))


def moment_errors(mean: Column, std: Column, true_mean: Column, true_std: Column) -> tuple[Column, Column]:
    """Absolute errors of a mean and a standard deviation."""
    return F.abs(mean - true_mean), F.abs(std - true_std)


def regression_errors(truth: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates ``mse, mae, r2``; without variation of the truth ``r2`` is 1 for no error and else 0."""
    rest, spread = F.sum((truth - predicted) ** 2), F.var_pop(truth) * F.count(truth)
    flat = F.when(rest == 0, 1.0).otherwise(0.0)
    return {"mse": F.avg((truth - predicted) ** 2), "mae": F.avg(F.abs(truth - predicted)), "r2": F.when(spread == 0, flat).otherwise(1 - rest / spread)}
