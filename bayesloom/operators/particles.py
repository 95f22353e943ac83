"""Particle inference: rows of (query, particle), one column for each variable, and a log weight.

A step adds one variable: a draw from its table or regression, or its clamped value. Evidence
weighs, interventions do not. Variables that are no ancestors of the target or the evidence are
pruned, which changes no weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform
from ..plans.kept import kept
from . import binned, features, kernel
from . import cpt as tables
from .conditional import Conditional
from .gaussian import Linear, density_grid
from .process import Process


@dataclass
class Kernel:
    """A kernel density: one row of points."""

    child: str
    parents: list[str]
    points: DataFrame
    bandwidth: float
    parent_bandwidth: float
    least: float = 0.0
    family = "kde"

    def draw(self, rows: DataFrame, seed: int, keys: list[str]) -> DataFrame:
        return kernel.draw(rows, self.points, self.child, self.parents, F.lit(seed), *keys, bandwidth=self.bandwidth, parent_bandwidth=self.parent_bandwidth, least=self.least)

    def log_prob(self, rows: DataFrame) -> DataFrame:
        return kernel.log_prob(rows, self.points, self.child, self.parents, self.bandwidth, self.parent_bandwidth, self.least)

    def size(self) -> dict:
        return {"points": self.points.select(F.size("points")).first()[0]}


@dataclass
class Features:
    """A Gaussian whose mean is linear in random features."""

    child: str
    parents: list[str]
    model: features.RandomFeatures
    family = "rff_gaussian"

    def draw(self, rows: DataFrame, seed: int, keys: list[str]) -> DataFrame:
        noise = F.lit(self.model.std) * normal(F.lit(seed), *keys, F.lit(self.child))
        return features.predict(rows, self.model, "_mean").withColumn(self.child, F.col("_mean") + noise).drop("_mean")

    def with_params(self, rows: DataFrame) -> DataFrame:
        return features.predict(rows, self.model, "_mean").withColumn("_std", F.lit(float(self.model.std)))

    def log_prob(self, rows: DataFrame) -> DataFrame:
        return features.predict(rows, self.model, "_mean").withColumn("log_prob", self.model.log_density("_mean")).drop("_mean")

    def size(self) -> dict:
        return {"features": len(self.model.phase), "std": self.model.std}


@dataclass
class Bins:
    """Frequencies of bins by parents' values, and a density within bins."""

    child: str
    parents: list[str]
    edges: list[float]
    probs: DataFrame
    within: str
    family = "binned"

    def _edges(self) -> Column:
        return F.array(*[F.lit(float(e)) for e in self.edges])

    def draw(self, rows: DataFrame, seed: int, keys: list[str]) -> DataFrame:
        at = binned.draw_bin(self.probs, rows, self.parents, uniform(F.lit(seed), *keys, F.lit(self.child), F.lit("bin")))
        return at.withColumn(self.child, binned.draw_within(F.col("bin"), self._edges(), uniform(F.lit(seed), *keys, F.lit(self.child)), self.within, normal(F.lit(seed), *keys, F.lit(self.child)))).drop("bin")

    def log_prob(self, rows: DataFrame) -> DataFrame:
        at = rows.withColumn("bin", binned.bin_of(F.col(self.child).cast("double"), self._edges()))
        joined = at.join(self.probs.withColumnRenamed("prob", "_p"), [*self.parents, "bin"], "left")
        return joined.withColumn("log_prob", binned.log_density(F.col(self.child).cast("double"), self._edges(), F.col("_p"), self.within)).select(*rows.columns, "log_prob")

    def size(self) -> dict:
        return {"bins": len(self.edges) - 1, "cells": self.probs.count()}


@dataclass
class Network:
    """Nodes in topological order with their parents, and a table, a regression or another family for each."""

    parents: dict[str, list[str]]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    linear: dict[str, Linear] = field(default_factory=dict)
    others: dict[str, Kernel | Features | Bins | Conditional | Process] = field(default_factory=dict)

    def order(self) -> list[str]:
        done: list[str] = []
        left = dict(self.parents)
        while left:
            ready = sorted(c for c, p in left.items() if all(q in done for q in p))
            if not ready:
                raise ValueError(f"cycle among {sorted(left)}")
            done += ready
            for c in ready:
                del left[c]
        return done

    def ancestors(self, of: set[str], cut: set[str]) -> set[str]:
        """``of`` and all above, with the edges into ``cut`` removed."""
        found, todo = set(of), list(of)
        while todo:
            v = todo.pop()
            for p in [] if v in cut else self.parents[v]:
                if p not in found:
                    found.add(p)
                    todo.append(p)
        return found

    def descendants(self, of: str) -> set[str]:
        found, grew = {of}, True
        while grew:
            new = {c for c, p in self.parents.items() if found & set(p)} - found
            found |= new
            grew = bool(new)
        return found - {of}


def draw(net: Network, rows: DataFrame, v: str, seed: int, keys: list[str]) -> DataFrame:
    """``rows`` with a draw of ``v`` given its parents' columns; ``keys`` tell the draws apart."""
    if v in net.tables:
        return tables.draw(rows, net.tables[v], v, net.parents[v], F.lit(seed), *keys)
    if v in net.others:
        return net.others[v].draw(rows, seed, keys)
    return rows.withColumn(v, net.linear[v].mean() + F.lit(net.linear[v].std) * normal(F.lit(seed), *keys, F.lit(v)))


def log_prob(net: Network, rows: DataFrame, v: str) -> DataFrame:
    """``rows`` with ``log_prob`` of ``v`` given its parents."""
    if v in net.tables:
        return tables.log_prob(rows, net.tables[v], v, net.parents[v])
    if v in net.others:
        return net.others[v].log_prob(rows)
    return rows.withColumn("log_prob", net.linear[v].log_density())


def is_gaussian(net: Network, v: str) -> bool:
    """Whether ``v`` is normal given its parents, so that its mean and spread come without draws."""
    return v in net.linear or isinstance(net.others.get(v), Conditional | Features | Process)


def with_params(net: Network, rows: DataFrame, v: str) -> DataFrame:
    """``rows`` with ``_mean`` and ``_std`` of a normal variable given its parents."""
    if v in net.linear:
        return rows.withColumn("_mean", net.linear[v].mean()).withColumn("_std", F.lit(float(net.linear[v].std)))
    return net.others[v].with_params(rows)


def forward(net: Network, queries: DataFrame, n: int, evidence: list[str], do: list[str], seed: int = 0, targets: list[str] | None = None, weigh: bool = True) -> DataFrame:
    """``query_id, particle_id, variables..., log_w``. Clamped variables are columns ``ev_<name>`` and ``do_<name>`` of ``queries``."""
    both = set(evidence) & set(do)
    if both:
        raise ValueError(f"in evidence and intervention: {sorted(both)}")
    needed = net.ancestors({*(targets or net.parents), *evidence}, set(do))
    rows = queries.withColumn("particle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("log_w", F.lit(0.0))
    for v in [v for v in net.order() if v in needed]:
        p = net.parents[v]
        if v in do:
            rows = rows.withColumn(v, F.col(f"do_{v}"))
        elif v in evidence:
            rows = rows.withColumn(v, F.col(f"ev_{v}"))
            if weigh:
                rows = log_prob(net, rows, v)
                rows = rows.withColumn("log_w", F.col("log_w") + F.col("log_prob")).drop("log_prob")
        else:
            rows = draw(net, rows, v, seed, ["query_id", "particle_id"])
    return rows


def with_weights(particles: DataFrame) -> DataFrame:
    """Normalised ``weight`` per query by a shifted softmax; uniform where every weight is zero."""
    w = Window.partitionBy("query_id")
    shifted = F.when(F.max("log_w").over(w) == float("-inf"), 1.0).otherwise(F.exp(F.col("log_w") - F.max("log_w").over(w)))
    out = particles.withColumn("_e", shifted)
    return out.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def statistics(weighted: DataFrame, target: str, ddof_std: bool = False) -> DataFrame:
    """``query_id, mean, std, ess`` of weighted particles; negative weights count as zero, no weight as uniform."""
    w = F.greatest(F.col("weight"), F.lit(0.0))
    v = F.col(target).cast("double")
    total = F.sum(w)
    moments = weighted.groupBy("query_id").agg(total.alias("_w"), F.sum(w * v).alias("_m"), F.sum(w * v * v).alias("_q"), F.sum(w * w).alias("_w2"), F.count("*").alias("_n"), F.avg(v).alias("_a"), F.avg(v * v).alias("_b"))
    mean = F.when(F.col("_w") > 0, F.col("_m") / F.col("_w")).otherwise(F.col("_a"))
    square = F.when(F.col("_w") > 0, F.col("_q") / F.col("_w")).otherwise(F.col("_b"))
    ess = F.when(F.col("_w") > 0, F.col("_w") * F.col("_w") / F.col("_w2")).otherwise(F.col("_n").cast("double"))
    return moments.select("query_id", mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), ess.alias("ess"))


def pmf(weighted: DataFrame, target: str) -> DataFrame:
    """``query_id, target, prob`` by summed weights."""
    sums = weighted.groupBy("query_id", target).agg(F.sum("weight").alias("_s"))
    return sums.select("query_id", target, (F.col("_s") / F.sum("_s").over(Window.partitionBy("query_id"))).alias("prob"))


def effective_size(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("query_id").agg((1 / F.sum(F.col("weight") ** 2)).alias("ess"))


def importance_sampling(net: Network, queries: DataFrame, n: int, evidence: list[str], do: list[str], target: str, seed: int = 0, fraction: float = 0.1) -> DataFrame:
    """Likelihood weighting, with twice the particles for those queries whose effective size is under a fraction of ``n``."""
    first = with_weights(forward(net, queries, n, evidence, do, seed, [target]))
    weak = effective_size(first).where(F.col("ess") < max(1.0, fraction * n)).select("query_id")
    again = with_weights(forward(net, queries.join(weak, "query_id", "left_semi"), 2 * n, evidence, do, seed + 1, [target]))
    return first.join(weak, "query_id", "left_anti").unionByName(again)


def _copies(weighted: DataFrame, u: Column) -> DataFrame:
    """``weighted`` with ``_k``, how often systematic resampling with the query's offset ``u`` takes each particle, and the query's ``_n``."""
    w = Window.partitionBy("query_id")
    rows = weighted.withColumn("_n", F.count("*").over(w)).withColumn("_hi", F.sum("weight").over(w.orderBy("particle_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.coalesce(F.lag("_hi").over(w.orderBy("particle_id")), F.lit(0.0))
    total = F.max("_hi").over(w)
    upto = lambda c: F.greatest(F.ceil(c / F.col("_t") * F.col("_n") - u), F.lit(0))
    rows = rows.withColumn("_t", total).withColumn("_lo", before)
    return rows.withColumn("_k", (F.least(upto(F.col("_hi")), F.col("_n")) - F.least(upto(F.col("_lo")), F.col("_n"))).cast("int")).drop("_hi", "_lo", "_t")


def _copied(rows: DataFrame) -> DataFrame:
    """As many rows as ``_k`` says, with ``particle_id`` counted anew within each query."""
    rows = rows.where("_k > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    w = Window.partitionBy("query_id").orderBy("particle_id", "_i")
    return rows.withColumn("_new", F.row_number().over(w) - 1).drop("particle_id", "_k", "_i").withColumnRenamed("_new", "particle_id")


def resample(weighted: DataFrame, seed: int = 0) -> DataFrame:
    """Systematic resampling per query: as many particles as before, each of weight 1/n."""
    rows = _copied(_copies(weighted, uniform(F.lit(seed), "query_id", F.lit("resample"))))
    return rows.withColumn("weight", 1 / F.col("_n")).withColumn("log_w", F.lit(0.0)).drop("_n")


def sequential(net: Network, queries: DataFrame, n: int, evidence: list[str], do: list[str], seed: int = 0, targets: list[str] | None = None, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Particles that are resampled along the way, and a log of it: sequential Monte Carlo over the topological order.

    After each evidence variable the effective size of each query is found; the particles of those queries where it is
    under ``threshold`` (up to 1 a fraction of ``n``, at least one particle; above, a number) are resampled
    systematically and weigh alike from there on, those of all other queries go on with their weights. Variables that
    come later are drawn for each copy by itself. A query whose particles all have no weight is not resampled.

    The log is ``query_id, step, node, ess, resampled``. Everything is one plan, cut once at its end.
    """
    least = max(1.0, threshold * n) if threshold <= 1 else float(threshold)
    needed = net.ancestors({*(targets or net.parents), *evidence}, set(do))
    order = [v for v in net.order() if v in needed]
    rows = queries.withColumn("particle_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("log_w", F.lit(0.0))
    rows = rows.withColumn("_log", F.array().cast("array<struct<step:int,node:string,ess:double,resampled:boolean>>"))
    for v in order:
        if v in do:
            rows = rows.withColumn(v, F.col(f"do_{v}"))
        elif v not in evidence:
            rows = draw(net, rows, v, seed, ["query_id", "particle_id"])
        else:
            rows = log_prob(net, rows.withColumn(v, F.col(f"ev_{v}")), v)
            rows = with_weights(rows.withColumn("log_w", F.col("log_w") + F.col("log_prob")).drop("log_prob"))
            rows = rows.withColumn("_ess", 1 / F.sum(F.col("weight") ** 2).over(Window.partitionBy("query_id")))
            rows = _copies(rows, uniform(F.lit(seed), "query_id", F.lit(v), F.lit("resample")))
            weak = F.col("_ess") < least
            entry = F.struct(F.lit(order.index(v)).alias("step"), F.lit(v).alias("node"), F.col("_ess").alias("ess"), weak.alias("resampled"))
            rows = rows.withColumn("_log", F.concat("_log", F.array(entry)))
            rows = rows.withColumn("_k", F.when(weak, F.col("_k")).otherwise(1)).withColumn("log_w", F.when(weak, 0.0).otherwise(F.col("log_w")))
            rows = _copied(rows.drop("weight", "_n", "_ess"))
    done = kept(with_weights(rows))
    first = done.where("particle_id = 0").select("query_id", F.explode("_log").alias("l"))
    return done.drop("_log"), first.select("query_id", "l.*")


def rao_blackwell(net: Network, queries: DataFrame, n: int, evidence: list[str], do: list[str], target: str, seed: int = 0) -> DataFrame:
    """``query_id, target, prob``: the target's table averaged over weighted draws of its parents.

    Evidence or interventions below the target fall back to weighted counts of the target.
    """
    if net.descendants(target) & {*evidence, *do} or target not in net.tables:
        return pmf(with_weights(forward(net, queries, n, evidence, do, seed, [target])), target)
    p = net.parents[target]
    above = with_weights(forward(net, queries, n, evidence, do, seed, p or [next(iter(net.parents))]))
    mixed = above.drop(target).join(net.tables[target].select(*p, target, "prob"), p) if p else above.drop(target).crossJoin(net.tables[target].select(target, "prob"))
    return mixed.groupBy("query_id", target).agg(F.sum(F.col("weight") * F.col("prob")).alias("prob"))


def rao_blackwell_density(net: Network, queries: DataFrame, n: int, evidence: list[str], do: list[str], target: str, points: int = 200, width: float = 4.0, seed: int = 0, chunk: int = 64) -> DataFrame:
    """``query_id, point, value, density``: a normal target's mixture over weighted draws of what stands above it.

    The target itself is not drawn. Each query's grid spans its mixture's mean plus and minus ``width`` standard
    deviations. Particles of equal parameters are one component; components go into arrays of about ``chunk``,
    each of which adds one term to each point's sum, so that there is no row for each component and point.
    """
    above = net.parents[target]
    drawn = with_weights(forward(net, queries, n, evidence, do, seed, above)) if above else queries.withColumn("particle_id", F.lit(0)).withColumn("weight", F.lit(1.0))
    normals = with_params(net, drawn.drop(target), target).groupBy("query_id", "_mean", "_std").agg(F.sum("weight").alias("w"), F.min("particle_id").alias("_first"))
    part = F.struct("w", F.col("_mean").alias("m"), F.col("_std").alias("s"))
    chunks = normals.groupBy("query_id", F.floor(F.col("_first") / chunk).alias("_chunk")).agg(F.sort_array(F.collect_list(part)).alias("_parts"))  # at most ``chunk`` in each
    added = lambda f: F.sum(F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["w"] * f(x)))
    spans = chunks.groupBy("query_id").agg(added(lambda x: x["m"]).alias("_m"), added(lambda x: x["s"] * x["s"] + x["m"] * x["m"]).alias("_q"), added(lambda x: F.lit(1.0)).alias("_w"))
    spans = spans.select("query_id", (F.col("_m") / F.col("_w")).alias("_centre"), F.sqrt(F.greatest(F.col("_q") / F.col("_w") - (F.col("_m") / F.col("_w")) ** 2, F.lit(0.0))).alias("_spread"))
    grid = density_grid(spans, F.col("_centre"), F.col("_spread"), points, width).select("query_id", "point", "value")
    z = lambda x: (F.col("value") - x["m"]) / x["s"]
    term = F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x["w"] * F.exp(-0.5 * z(x) * z(x)) / (x["s"] * math.sqrt(2 * math.pi)))
    return chunks.join(grid, "query_id").groupBy("query_id", "point", "value").agg(F.sum(term).alias("density"))


def relative(a: DataFrame, b: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Differences of two posteriors' statistics: by query, or against the one row of ``b``."""
    ref = b.select("query_id", F.col("mean").alias("ref_mean"), F.col("std").alias("ref_std"))
    if len(ref.limit(2).collect()) == 1:
        both = a.crossJoin(F.broadcast(ref.drop("query_id")))  # one row
    else:
        both = a.join(ref, "query_id")
    return both.select("query_id", "mean", "ref_mean", (F.col("mean") - F.col("ref_mean")).alias("delta_mean"), (F.col("std") - F.col("ref_std")).alias("delta_std"), ((F.col("mean") - F.col("ref_mean")) / F.greatest(F.abs("ref_mean"), F.lit(eps))).alias("relative_mean"))


def damp(weighted: DataFrame, rounds: int, damping: float, eps: float = 1e-12) -> tuple[DataFrame, float | None]:
    """Weights clipped to ``eps``, renormalised and mixed with what they were, ``rounds`` times; and by how much the last round moved any."""
    w, rows = Window.partitionBy("query_id"), weighted
    for _ in range(rounds):
        clipped = F.greatest("weight", F.lit(eps))
        rows = rows.withColumn("_c", clipped).withColumn("_c", F.col("_c") / (F.sum("_c").over(w) + eps))
        rows = rows.withColumn("_m", damping * F.col("_c") + (1 - damping) * F.col("weight")).withColumn("_m", F.col("_m") / (F.sum("_m").over(w) + eps))
        rows = rows.withColumn("_d", F.abs(F.col("_m") - F.col("weight"))).withColumn("weight", F.col("_m")).drop("_c", "_m")
    if not rounds:
        return rows, None
    return rows.drop("_d"), rows.agg(F.max("_d")).first()[0]


def gibbs(net: Network, queries: DataFrame, n: int, evidence: list[str], do: list[str], seed: int = 0, burn_in: int = 10, every: int = 1, candidates: int = 8) -> DataFrame:
    """``query_id, particle_id, variables...``: one chain for each query and draw, after ``burn_in`` + ``every`` sweeps.

    Chains run side by side instead of one after another, so that a sweep is one plan over all of
    them. A sweep visits each free variable: candidates from its own family are scored by that
    family and by its children's, and one is chosen in proportion to the softmax of the scores by
    a hashed draw. The state is written to the checkpoint folder after each sweep.
    """
    free = [v for v in net.order() if v not in {*evidence, *do}]
    children = {v: [c for c, p in net.parents.items() if v in p and c not in do] for v in net.parents}
    state = forward(net, queries, n, evidence, do, seed, weigh=False).drop("log_w")
    columns = state.columns
    for sweep in range(burn_in + max(every, 1)):
        for v in free:
            many = state.drop(v).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
            many = draw(net, many, v, seed + 1, ["query_id", "particle_id", F.lit(sweep), "_k"])
            score = F.lit(0.0)
            for i, c in enumerate([v, *children[v]]):
                many = log_prob(net, many, c).withColumnRenamed("log_prob", f"_s{i}")
                score = score + F.col(f"_s{i}")
            items = F.sort_array(F.collect_list(F.struct("_k", score.alias("s"), F.col(v).alias("v"))))
            rest = [F.first(c).alias(c) for c in columns if c not in ("query_id", "particle_id", v)]
            met = many.groupBy("query_id", "particle_id").agg(items.alias("_i"), *rest)  # at most ``candidates`` rows each
            top = F.array_max(F.transform("_i", lambda x: x["s"]))
            weight = F.transform("_i", lambda x: F.when(F.isnan(x["s"] - top), 1.0).otherwise(F.exp(x["s"] - top)))
            sums = F.aggregate(weight, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
            u = uniform(F.lit(seed + 2), "query_id", "particle_id", F.lit(sweep), F.lit(v), F.lit("choice"))
            met = met.withColumn("_c", sums).withColumn("_u", u)
            at = F.least(F.size(F.filter("_c", lambda c: c <= F.col("_u") * F.element_at("_c", -1))) + 1, F.size("_i"))
            state = met.withColumn(v, F.element_at("_i", at)["v"]).select(*columns)
        state = kept(state)
    return state


def histogram(values: DataFrame, column: str, bins: int = 30, weight: Column | None = None) -> DataFrame:
    """``bin, lo, hi, density`` of a column over its range; an empty range is widened by half to each side."""
    span = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    span = span.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    w = weight if weight is not None else F.lit(1.0)
    rows = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.alias("bin"), "lo", "hi").agg(F.sum(w).alias("_s"))
    total = F.sum("_s").over(Window.partitionBy())
    return rows.select("bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), (F.col("_s") / total / width).alias("density"))


