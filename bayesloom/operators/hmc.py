"""Hamiltonian Monte Carlo: a chain for each query and draw, all of them side by side in one frame.

Gradients of the joint log density are column expressions; the leapfrog steps of one move are projections, and the
move ends with a Metropolis test by a hashed draw. Lineage is cut after each move. A family whose gradient is not
written here (bins, networks of units) counts as flat: its variables move by momentum alone, and the
test, which takes every family's own log density, keeps the answer right.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform
from ..plans.kept import kept
from . import kernel, particles
from .conditional import Conditional


def _numbers(xs) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def _normal_parts(net: particles.Network, v: str) -> tuple[Column, Column, dict[str, Column]] | None:
    """Mean, spread and the mean's slope in each parent of a normal family, as expressions over a row."""
    if v in net.linear:
        f = net.linear[v]
        return f.mean(), F.lit(float(f.std)), {p: F.lit(float(c)) for p, c in zip(f.parents, f.coef, strict=True)}
    family = net.others.get(v)
    if isinstance(family, Conditional):
        r = F.col(f"_r_{v}")
        slopes = {p: F.get(r["coef"], F.lit(i)) for i, p in enumerate(family.continuous)}
        mean = r["intercept"]
        for p, s in slopes.items():
            mean = mean + s * F.col(p)
        return mean, r["std"], slopes
    if isinstance(family, particles.Features):
        m = family.model
        waves = F.array(*[F.struct(_numbers(a).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(w) * math.sqrt(2 / len(m.phase))).alias("w")) for a, b, w in zip(m.axes.T, m.phase, m.weights, strict=False)])
        z = [(F.col(p).cast("double") - float(c)) / float(s) for p, c, s in zip(m.parents, m.center[1:], m.spread[1:], strict=True)]

        def angle(x: Column) -> Column:
            out = x["b"]
            for i, zi in enumerate(z):
                out = out + F.get(x["a"], F.lit(i)) * zi
            return out

        total = lambda f: F.aggregate(waves, F.lit(0.0), lambda acc, x: acc + x["w"] * f(x))
        mean = float(m.center[0]) + float(m.spread[0]) * (total(lambda x: F.cos(angle(x))) + float(m.weights[-1]))
        slopes = {p: -float(m.spread[0] / m.spread[i + 1]) * total(lambda x, i=i: F.sin(angle(x)) * F.get(x["a"], F.lit(i))) for i, p in enumerate(m.parents)}
        return mean, F.lit(float(m.std)), slopes
    return None


def _kernel_gradient(family: particles.Kernel, of: str) -> Column:
    """Slope of a kernel family's log density in its child or in a parent, from the attached points."""
    points = F.col(f"_k_{family.child}")
    wide, parent_wide = kernel.scale(family.bandwidth, family.least), kernel.scale(family.parent_bandwidth, family.least)
    above = lambda t: kernel.parent_kernel(t, family.parents, parent_wide)
    whole = lambda t: above(t) + kernel.child_kernel(t, family.child, wide)

    def pull(weight, width: float) -> Column:
        """Mean of (point - x) / width^2 under the softmax of ``weight``."""
        logs = F.transform(points, weight)
        top = F.array_max(logs)
        sums = F.aggregate(points, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s")), lambda a, t: F.struct((a["w"] + F.exp(weight(t) - top)).alias("w"), (a["s"] + F.exp(weight(t) - top) * (t[of] - F.col(of))).alias("s")))
        return sums["s"] / sums["w"] / F.lit(width * width)

    if of == family.child:
        return pull(whole, wide)
    return pull(whole, parent_wide) - pull(above, parent_wide)


def gradient(net: particles.Network, v: str, nodes: list[str]) -> Column:
    """Slope in ``v`` of the summed log density of ``nodes``."""
    out = F.lit(0.0)
    for c in nodes:
        if c != v and v not in net.parents[c]:
            continue
        family = net.others.get(c)
        if isinstance(family, particles.Kernel):
            out = out + _kernel_gradient(family, v)
            continue
        parts = _normal_parts(net, c)
        if parts is None:
            continue
        mean, std, slopes = parts
        rest = (F.col(c).cast("double") - mean) / (std * std)
        if c == v:
            out = out - rest
        elif v in slopes:
            out = out + rest * slopes[v]
    return out


def _log_joint(net: particles.Network, rows: DataFrame, nodes: list[str], name: str) -> DataFrame:
    """``rows`` with the summed log density of ``nodes``, each by its own family."""
    total = F.lit(0.0)
    columns = rows.columns
    for i, v in enumerate(nodes):
        rows = particles.log_prob(net, rows, v).withColumnRenamed("log_prob", f"_lp{i}")
        total = total + F.col(f"_lp{i}")
    return rows.select(*columns, total.alias(name))


def sample(net: particles.Network, queries: DataFrame, n: int, evidence: list[str], do: list[str], seed: int = 0, burn_in: int = 10, moves: int = 1, step: float = 0.05, leapfrogs: int = 8, scales: dict[str, float] | None = None) -> DataFrame:
    """``query_id, particle_id, variables...``: the state of each chain after ``burn_in`` + ``moves`` moves.

    Chains start from forward draws. ``scales`` stretches the step of single variables. With a free variable that has
    values instead of a density (tables, classes), or without a free one, draws are forward ones.
    """
    free = [v for v in net.order() if v not in {*evidence, *do}]
    valued = [v for v in free if v in net.tables or getattr(net.others.get(v), "family", "") in ("softmax_nn", "categorical_embedded_softmax")]
    start = particles.forward(net, queries, n, evidence, do, seed, weigh=False).drop("log_w")
    if valued or not free:
        return start
    nodes = [v for v in net.order() if v not in do and (v in free or set(net.parents[v]) & set(free))]
    keys = ["query_id", "particle_id"]
    for v in nodes:  # discrete parents are given, so that a chain keeps its configuration's regression
        family = net.others.get(v)
        if isinstance(family, Conditional):
            start = family.with_regression(start, f"_r_{v}")
    kernels = [net.others[v] for v in nodes if isinstance(net.others.get(v), particles.Kernel)]
    scale = {v: float((scales or {}).get(v, 1.0)) for v in free}
    start = start.select(*[c for c in start.columns if c not in free], *[F.col(v).cast("double").alias(v) for v in free])
    state = kept(_log_joint(net, start, nodes, "_log"))
    columns = state.columns
    for move in range(burn_in + max(moves, 1)):
        rows = state
        for f in kernels:
            rows = rows.crossJoin(F.broadcast(f.points.select(F.col("points").alias(f"_k_{f.child}"))))  # one bounded row
        pushes = {v: gradient(net, v, nodes) * scale[v] for v in free}
        rows = rows.select("*", *[F.col(v).alias(f"_q_{v}") for v in free], *[normal(F.lit(seed), *keys, F.lit(move), F.lit(v), F.lit("momentum")).alias(f"_p_{v}") for v in free])
        energy = lambda: sum((F.col(f"_p_{v}") * F.col(f"_p_{v}") for v in free), F.lit(0.0)) / 2
        rows = rows.withColumn("_before", F.col("_log") - energy())
        rows = rows.withColumns({f"_p_{v}": F.col(f"_p_{v}") + step / 2 * g for v, g in pushes.items()})
        for i in range(max(leapfrogs, 1)):
            rows = rows.withColumns({v: F.col(v) + step * scale[v] * F.col(f"_p_{v}") for v in free})
            share = step if i < max(leapfrogs, 1) - 1 else step / 2
            rows = rows.withColumns({f"_p_{v}": F.col(f"_p_{v}") + share * g for v, g in pushes.items()})
        rows = rows.drop(*[f"_k_{f.child}" for f in kernels])
        rows = _log_joint(net, rows, nodes, "_new")
        gain = F.col("_new") - energy() - F.col("_before")
        takes = F.coalesce(~F.isnan(gain) & (uniform(F.lit(seed), *keys, F.lit(move), F.lit("accept")) < F.exp(F.least(gain, F.lit(0.0)))), F.lit(False))
        rows = rows.withColumn("_takes", takes)
        moved = {v: F.when(F.col("_takes"), F.col(v)).otherwise(F.col(f"_q_{v}")) for v in free}
        rows = rows.withColumns({**moved, "_log": F.when(F.col("_takes"), F.col("_new")).otherwise(F.col("_log"))})
        state = kept(rows.select(*columns))
    return state.drop("_log", *[c for c in columns if c.startswith("_r_")])
