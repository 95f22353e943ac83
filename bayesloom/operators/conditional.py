"""Conditional linear Gaussians: a regression for each configuration of the discrete parents, kept as a table.

Statistics are additive by configuration, so that batches merge by a sum. Regressions are solved where
the statistics are, configuration by configuration; the pooled regression is a row of the same
table and stands in for configurations with too few rows, and for those never seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import normal
from ..functions.scalars import normal_log_density
from . import gaussian


def statistics(df: DataFrame, child: str, discrete: list[str], parents: list[str], shift: dict[str, float]) -> DataFrame:
    """``discrete..., n, sums and cross products`` of the shifted columns, from one scan.

    Rows with a null in the child or in a continuous parent are left out; rows with a null among the discrete
    parents are a configuration of their own, which counts for the pooled regression alone.
    """
    rows = df.dropna(subset=[child, *parents])
    x = {c: F.col(c).cast("double") - F.lit(float(shift[c])) for c in [child, *parents]}
    aggs = [F.count("*").alias("n"), *[F.sum(v).alias(f"s_{c}") for c, v in x.items()]]
    aggs += [F.sum(x[a] * x[b]).alias(f"q_{a}__{b}") for i, a in enumerate(x) for b in list(x)[i:]]
    return rows.groupBy(*discrete).agg(*aggs)


def merged(a: DataFrame, b: DataFrame, discrete: list[str]) -> DataFrame:
    """Statistics of two batches, taken with the same shift, as those of both."""
    sums = [c for c in a.columns if c not in discrete]
    return a.unionByName(b).groupBy(*discrete).agg(*[F.sum(c).alias(c) for c in sums])


def solved(stats: DataFrame, child: str, discrete: list[str], parents: list[str], shift: dict[str, float], ridge: float = 0.0, least: float = 1e-6, least_rows: int | None = None) -> DataFrame:
    """``discrete..., pooled, n, intercept, coef, std`` for each configuration of at least ``least_rows`` rows, and the pooled row.

    The residual variance is over n - (p + 1), at least 1; ``least_rows`` is p + 2 unless given. A
    singular configuration (a parent that does not vary) takes the shortest of all solutions.
    """
    p = len(parents)
    enough = p + 2 if least_rows is None else least_rows
    sums = [c for c in stats.columns if c not in discrete]
    whole = stats.agg(*[F.sum(c).alias(c) for c in sums]).select(*[F.lit(None).cast(stats.schema[c].dataType).alias(c) for c in discrete], F.lit(True).alias("pooled"), *sums)
    known = F.lit(True)
    for c in discrete:
        known = known & F.col(c).isNotNull()
    each = stats.where(known & (F.col("n") >= enough)).select(*discrete, F.lit(False).alias("pooled"), *sums)
    kinds = {f.name: f.dataType.simpleString() for f in stats.schema}

    def solve(frames):
        for frame in frames:
            out = frame[[*discrete, "pooled", "n"]].copy()
            fits = [gaussian.solve(s, child, parents, shift, ridge, 0.0) for s in frame[sums].fillna(0).to_dict("records")]
            out["n"] = frame["n"].fillna(0).astype("int64")
            out["intercept"] = [f.intercept for f in fits]
            out["coef"] = [list(f.coef) for f in fits]
            old = [(n - 1 if parents else n) for n in out["n"]]
            out["std"] = [max(f.std * (max(o, 1) / max(n - (p + 1), 1)) ** 0.5 if n else 1.0, least) for f, o, n in zip(fits, old, out["n"], strict=True)]
            yield pd.DataFrame(out)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in discrete], "pooled boolean, n long, intercept double, coef array<double>, std double"])
    return each.unionByName(whole).mapInPandas(solve, schema)


@dataclass
class Conditional:
    """A child's regressions as a table, joined to rows by the discrete parents."""

    child: str
    parents: list[str]
    discrete: list[str]
    table: DataFrame
    family = "conditional_gaussian"
    continuous: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.continuous = [p for p in self.parents if p not in self.discrete]

    def with_regression(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with a struct of intercept, coefficients and spread; the pooled one where there is none for the configuration."""
        part = F.struct("intercept", "coef", "std")
        own = self.table.where("NOT pooled").select(*self.discrete, part.alias("_own"))
        pooled = self.table.where("pooled").select(part.alias("_pooled"))  # one row
        both = (rows.join(own, self.discrete, "left") if self.discrete else rows.withColumn("_own", F.lit(None).cast(own.schema["_own"].dataType))).crossJoin(F.broadcast(pooled))
        return both.select(*rows.columns, F.coalesce("_own", "_pooled").alias(name))

    def with_params(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_mean`` and ``_std`` of the child."""
        took = self.with_regression(rows, "_r")
        mean: Column = F.col("_r.intercept")
        for i, p in enumerate(self.continuous):
            mean = mean + F.get(F.col("_r.coef"), F.lit(i)) * F.col(p).cast("double")
        return took.select(*rows.columns, mean.alias("_mean"), F.col("_r.std").alias("_std"))

    def draw(self, rows: DataFrame, seed: int, keys: list[str]) -> DataFrame:
        noise = F.col("_std") * normal(F.lit(seed), *keys, F.lit(self.child))
        return self.with_params(rows).withColumn(self.child, F.col("_mean") + noise).drop("_mean", "_std")

    def log_prob(self, rows: DataFrame) -> DataFrame:
        return self.with_params(rows).withColumn("log_prob", normal_log_density(F.col(self.child).cast("double"), F.col("_mean"), F.col("_std"))).drop("_mean", "_std")

    def size(self) -> dict:
        return {"configurations": self.table.where("NOT pooled").count(), "coefficients": len(self.continuous)}
