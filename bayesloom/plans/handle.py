"""One node's fitted family: draws, densities, and its distribution given parents."""

from __future__ import annotations

from copy import copy, deepcopy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cpt, gaussian, particles
from . import stored


class Handle:
    """Answers for rows of parents; each row keeps its columns. Rows that lack a parent's column are an error."""

    def __init__(self, net: particles.Network, node: str, seed: int = 0, settings: dict | None = None):
        self.net, self.node, self.parents, self.seed, self.settings = net, node, net.parents[node], seed, dict(settings or {})

    def _check(self, rows: DataFrame, *also: str) -> None:
        missing = {*self.parents, *also} - set(rows.columns)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def family(self) -> str:
        if self.node in self.net.tables:
            return "categorical_table"
        return "linear_gaussian" if self.node in self.net.linear else self.net.others[self.node].family

    def sample(self, rows: DataFrame, n: int = 1, key: str = "row_id") -> DataFrame:
        """``n`` draws for each row of parents, told apart by ``key`` and ``draw_id``."""
        self._check(rows, key)
        many = rows.drop(self.node).withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return particles.draw(self.net, many, self.node, self.seed, [key, "draw_id"])

    def log_prob(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``log_prob`` of the node's value."""
        self._check(rows, self.node)
        return particles.log_prob(self.net, rows, self.node)

    def pdf(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``pdf``: the density or probability of the node's value."""
        return self.log_prob(rows).withColumn("pdf", F.exp("log_prob")).drop("log_prob")

    forward = sample

    def conditional(self, rows: DataFrame, n: int = 200, key: str = "row_id") -> DataFrame:
        """``rows`` with a struct ``conditional`` (``kind``, ``mean``, ``std``, ``values``, ``probs``).

        A regression has its parameters, a table its probabilities by value, any other family the
        moments of ``n`` draws (population standard deviation).
        """
        self._check(rows, key)
        none, no = F.lit(None).cast("double"), F.lit(None)

        def described(kind: str, mean, std, values, probs):
            return F.struct(F.lit(kind).alias("kind"), mean.alias("mean"), std.alias("std"), values.cast("array<string>").alias("values"), probs.cast("array<double>").alias("probs")).alias("conditional")

        if self.node in self.net.linear:
            f = self.net.linear[self.node]
            return rows.select("*", described("normal_params", f.mean(), F.lit(f.std), no, no))
        if self.node in self.net.tables:
            item = F.sort_array(F.collect_list(F.struct(F.col(self.node).alias("v"), F.col("prob").alias("p"))))
            table = self.net.tables[self.node].groupBy(*self.parents).agg(item.alias("_i"))
            both = rows.join(table, self.parents, "left") if self.parents else rows.crossJoin(table)
            said = described("categorical_probs", none, none, F.transform("_i", lambda x: x["v"]), F.transform("_i", lambda x: x["p"]))
            return both.select(*rows.columns, said)
        drawn = self.sample(rows, n, key).groupBy(key).agg(F.avg(self.node).alias("_m"), F.stddev_pop(self.node).alias("_s"))
        return rows.join(drawn, key, "left").select(*rows.columns, described("empirical_samples", F.col("_m"), F.col("_s"), no, no))

    def conditional_mean_std(self, rows: DataFrame, n: int = 200, key: str = "row_id") -> DataFrame:
        """``rows`` with ``mean`` and ``std``: of the regression, of a table's numeric values, or of draws."""
        if self.node in self.net.tables:
            v = F.col(self.node).cast("double")
            t = cpt.lookup(rows.select(key, *self.parents), self.net.tables[self.node], self.node, self.parents)
            m = t.groupBy(key).agg(F.sum(F.col("prob") * v).alias("mean"), F.sum(F.col("prob") * v * v).alias("_q"))
            m = m.select(key, "mean", F.sqrt(F.greatest(F.col("_q") - F.col("mean") ** 2, F.lit(0.0))).alias("std"))
            return rows.join(m, key, "left")
        return self.conditional(rows, n, key).select(*rows.columns, "conditional.mean", "conditional.std")

    def summary(self) -> dict:
        """The family's name, parents, and the size of its parameters, or the parameters of a regression themselves."""
        out = {"node": self.node, "family": self.family(), "parents": list(self.parents)}
        if self.node in self.net.linear:
            f: gaussian.Linear = self.net.linear[self.node]
            return out | {"intercept": f.intercept, "coef": list(f.coef), "std": f.std}
        return out | ({"cells": self.net.tables[self.node].count()} if self.node in self.net.tables else self.net.others[self.node].size())

    def export_config(self) -> dict:
        """What it takes to fit the family again: node, parents, family and its settings."""
        return {"node": self.node, "parents": list(self.parents), "family": self.family(), "settings": dict(self.settings)}

    def state_dict(self) -> dict:
        """The fitted parameters: numbers as plain values, and a ``table`` where they are one."""
        if self.node in self.net.tables:
            return {"table": self.net.tables[self.node]}
        if self.node in self.net.linear:
            f = self.net.linear[self.node]
            return {"intercept": f.intercept, "coef": list(f.coef), "std": f.std}
        family = self.net.others[self.node]
        table = stored.table_of(family)
        table = table if table is not None else getattr(family, "table", getattr(family, "points", None))
        return stored.state_of(family) | ({"table": table} if table is not None else {})

    def clone(self) -> Handle:
        """A handle of the family alone, which later fits and updates of the model leave as it is."""
        n = self.node
        own = [{k: deepcopy(x) if k == n and part == "linear" else copy(x) for k, x in getattr(self.net, part).items() if k == n} for part in ("tables", "linear", "others")]
        return Handle(particles.Network({n: list(self.parents)} | {p: [] for p in self.parents}, *own), n, self.seed, self.settings)
