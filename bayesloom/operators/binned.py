"""Binned families: edges, the bin of a value, frequencies, densities and draws inside bins."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_log_density
from . import ordered

KINDS = ("uniform", "quantile", "gaussian")
WITHIN = ("uniform", "triangular", "gaussian")

#: Standard deviation of the gaussian inside a bin, as a share of the bin's width.
SCALE = 0.25


def increasing(edges: Column, least: float = 1e-6) -> Column:
    """Edges pushed up where they are not ``least`` above the one before."""

    def push(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.greatest(x, F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.lit(least), x))))

    return F.aggregate(edges, F.array().cast("array<double>"), push)


def bin_edges(df: DataFrame, value: str, bins: int, kind: str = "uniform", least: float = 1e-6) -> DataFrame:
    """One row with ``edges``: ``bins`` + 1 increasing numbers from the least value to the greatest.

    ``gaussian`` puts equal mass of a fitted normal between inner edges. Nulls do not count; without
    values the row has null edges.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of bins {kind!r}; there are {sorted(KINDS)}")
    x = F.col(value).cast("double")
    if kind == "quantile":
        return ordered.percentiles(df, value, [i / bins for i in range(bins + 1)]).select(increasing(F.col("values"), least).alias("edges"))
    lo, hi = F.min(x), F.max(x)
    if kind == "uniform":
        inner = [lo + (hi - lo) * (i / bins) for i in range(1, bins)]
    else:
        inner = [F.greatest(lo, F.least(hi, F.avg(x) + F.stddev_pop(x) * NormalDist().inv_cdf(i / bins))) for i in range(1, bins)]
    return df.agg(F.when(lo.isNotNull(), increasing(F.array(lo, *inner, hi), least)).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Edges at or below the value, less one, held within the bins; null for null."""
    k = F.size(edges) - 1
    at = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(at, k - 1))).cast("int")


def frequencies(df: DataFrame, bin_: str, bins: int, parents: list[str] = (), smoothing: float = 0.0, floor: float = 1e-12) -> DataFrame:
    """``parents..., bin, prob`` for every bin of every seen configuration, with label smoothing."""
    seen = df.where(F.col(bin_).isNotNull()).groupBy(*parents, F.col(bin_).alias("bin")).agg(F.count("*").alias("n"))
    total = seen.groupBy(*parents).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    rows = total.select(*parents, "total", "by_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    share = F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0)) / F.col("total")
    return rows.select(*parents, "bin", F.greatest((1 - smoothing) * share + smoothing / bins, F.lit(floor)).alias("prob"))


def log_density(value: Column, edges: Column, prob: Column, within: str = "uniform", clip: bool = False) -> Column:
    """Log density of a value whose bin has mass ``prob``; minus infinity outside the edges unless ``clip``.

    A gaussian around the bin's centre reaches over the edges; with ``clip`` the value is taken at the nearest edge.
    """
    if within not in WITHIN:
        raise ValueError(f"unknown density within bins {within!r}; there are {sorted(WITHIN)}")
    lo, hi = F.element_at(edges, 1), F.element_at(edges, -1)
    x = F.greatest(lo, F.least(hi, value)) if clip else value
    at = bin_of(x, edges)
    left, right = F.element_at(edges, at + 1), F.element_at(edges, at + 2)
    width = right - left
    if within == "gaussian":
        return F.ln(prob) + normal_log_density(x, (left + right) / 2, width * SCALE)
    if within == "uniform":
        inside = -F.ln(width)
    else:
        t = (x - left) / width
        inside = F.ln(F.greatest(4 * F.least(t, 1 - t), F.lit(1e-12)) / width)
    return F.when(x.between(lo, hi), F.ln(prob) + inside).otherwise(F.lit(float("-inf")))


def draw_within(bin_: Column, edges: Column, u: Column, within: str = "uniform", z: Column | None = None, clip: bool = False) -> Column:
    """A value inside a bin from a uniform number ``u``, or for a gaussian from a standard normal one ``z`` (held in the bin with ``clip``)."""
    if within not in WITHIN:
        raise ValueError(f"unknown density within bins {within!r}; there are {sorted(WITHIN)}")
    left, right = F.element_at(edges, bin_ + 1), F.element_at(edges, bin_ + 2)
    if within == "uniform":
        return left + u * (right - left)
    if within == "gaussian":
        if z is None:
            raise ValueError("a gaussian inside bins needs a normal draw")
        drawn = (left + right) / 2 + z * (right - left) * SCALE
        return F.greatest(left, F.least(right, drawn)) if clip else drawn
    return F.when(u < 0.5, left + (right - left) * F.sqrt(u / 2)).otherwise(right - (right - left) * F.sqrt((1 - u) / 2))


def draw_bin(probs: DataFrame, rows: DataFrame, parents: list[str], u: Column) -> DataFrame:
    """``rows`` with a ``bin`` drawn from their configuration's frequencies by inverse distribution."""
    w = Window.partitionBy(*parents).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulated = probs.withColumn("_c", F.sum("prob").over(w)).groupBy(*parents).agg(F.sort_array(F.collect_list("_c")).alias("_cdf"))
    joined = rows.join(cumulated, list(parents), "left") if parents else rows.crossJoin(F.broadcast(cumulated))  # one row without parents
    below = F.size(F.filter("_cdf", lambda c: c <= u * F.element_at("_cdf", -1)))
    return joined.withColumn("bin", F.least(below, F.size("_cdf") - 1).cast("int")).drop("_cdf")
