"""Kernel density families: a bounded set of points, one row, answers every query in place.

The points are one row's array, so that queries meet them without a shuffle and without rows
for each pair. ``max_points`` is the method's parameter and bounds that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import fast_uniform, normal, uniform
from ..functions.scalars import normal_log_density


def fit(df: DataFrame, child: str, parents: list[str] = (), max_points: int = 2000, seed: int = 0) -> DataFrame:
    """One row with ``points``: at most ``max_points`` complete rows as structs of doubles, each row alike likely.

    Rows are ordered by hashed exponential draws. Of ``n`` equal rows only the first ``max_points`` of
    their order statistics are drawn, from the spacings between them, so that copies count in
    proportion and the choice depends on the values alone.
    """
    columns = [child, *parents]
    rows = df.dropna(subset=columns).select(*[F.col(c).cast("double").alias(c) for c in columns]).groupBy(*columns).agg(F.count("*").alias("_n"))
    ranks = F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(max_points)).cast("int"))
    u = lambda i: fast_uniform(F.lit(seed), *[F.col(c) for c in columns], i)
    gaps = F.transform(ranks, lambda i: -F.ln(u(i)) / (F.col("_n") - i + 1))
    sums = F.aggregate(gaps, F.array().cast("array<double>"), lambda acc, g: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + g)))
    few = rows.select(*columns, F.explode(sums).alias("_at")).orderBy("_at", *columns).limit(max_points)
    return few.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("points"))


def sample(df: DataFrame, columns: list[str], max_points: int = 2000, seed: int = 0, identity: list[str] = ()) -> DataFrame:
    """At most ``max_points`` rows of ``order_key`` and ``columns`` (doubles): a sample that merges with others.

    A row's key is an exponential draw hashed from ``identity``, its values, and its number among copies; the rows of
    least keys are the sample. The samples of batches that share no identity (a row's id, or a batch's
    label) merge to exactly the sample of all their rows. Copies within an identity count in proportion: of ``n`` of them
    only the first ``max_points`` order statistics are drawn, from the spacings between them.
    """
    rows = df.dropna(subset=columns).select(*[F.col(c).alias(f"_i{k}") for k, c in enumerate(identity)], *[F.col(c).cast("double").alias(c) for c in columns])
    names = rows.columns
    rows = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    said = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    u = lambda i: (F.conv(F.substring(F.md5(F.concat_ws("|", said, i.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    gaps = F.transform(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(max_points)).cast("int")), lambda i: -F.ln(u(i)) / (F.col("_n") - i + 1))
    keys = F.when(F.col("_n") == 1, F.array(-F.ln(u(F.lit(1))))).otherwise(F.aggregate(gaps, F.array().cast("array<double>"), lambda acc, g: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + g))))
    return _least(rows.select(F.explode(keys).alias("order_key"), *columns), max_points)


def _least(rows: DataFrame, max_points: int) -> DataFrame:
    return rows.orderBy(*rows.columns).limit(max_points)


def merge(a: DataFrame, b: DataFrame, max_points: int = 2000) -> DataFrame:
    """The sample of two batches' rows from their samples, each of at least ``max_points`` or of the whole batch."""
    return _least(a.unionByName(b), max_points)


def as_points(drawn: DataFrame, child: str, parents: list[str] = ()) -> DataFrame:
    """A sample as the one row of ``points`` that densities and draws take."""
    return drawn.agg(F.sort_array(F.collect_list(F.struct(child, *parents))).alias("points"))


def scale(bandwidth: float, least: float = 0.0) -> float:
    return max(bandwidth, 1e-3) + least


def _log_sum_exp(logs: Column) -> Column:
    top = F.array_max(logs)
    return top + F.ln(F.aggregate(F.transform(logs, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))


def parent_kernel(point: Column, parents: list[str], width: float) -> Column:
    out = F.lit(0.0)
    for p in parents:
        out = out + normal_log_density(F.col(p), point[p], F.lit(width))
    return out


def child_kernel(point: Column, child: str, width: float) -> Column:
    return normal_log_density(F.col(child), point[child], F.lit(width))


def log_prob(queries: DataFrame, points: DataFrame, child: str, parents: list[str] = (), bandwidth: float = 0.5, parent_bandwidth: float = 0.5, least: float = 0.0) -> DataFrame:
    """``queries`` with ``log_prob`` of the child given the parents; null without points or with null values."""
    wide, parent_wide = scale(bandwidth, least), scale(parent_bandwidth, least)
    rows = queries.crossJoin(F.broadcast(points.where(F.size("points") > 0).withColumnRenamed("points", "_p")))  # one bounded row
    own = F.transform("_p", lambda t: parent_kernel(t, parents, parent_wide) + child_kernel(t, child, wide))
    below = _log_sum_exp(F.transform("_p", lambda t: parent_kernel(t, parents, parent_wide))) if parents else F.ln(F.size("_p").cast("double"))
    return rows.withColumn("log_prob", _log_sum_exp(own) - below).drop("_p")


def draw(rows: DataFrame, points: DataFrame, child: str, parents: list[str], seed: Column, *keys: str, bandwidth: float = 0.5, parent_bandwidth: float = 0.5, least: float = 0.0) -> DataFrame:
    """``rows`` with a draw of the child: a point in proportion to its parents' kernel, and normal noise."""
    parent_wide = scale(parent_bandwidth, least)
    out = rows.crossJoin(F.broadcast(points.where(F.size("points") > 0).withColumnRenamed("points", "_p")))  # one bounded row
    out = out.withColumn("_k", F.transform("_p", lambda t: parent_kernel(t, parents, parent_wide)))
    weights = F.transform("_k", lambda x: F.exp(x - F.array_max("_k")))
    zero = F.array().cast("array<double>")
    sums = F.aggregate(weights, zero, lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    out = out.withColumn("_c", sums).withColumn("_u", uniform(seed, *keys, F.lit(child), F.lit("point")))
    at = F.least(F.size(F.filter("_c", lambda c: c <= F.col("_u") * F.element_at("_c", -1))), F.size("_c") - 1) + 1
    noise = F.lit(scale(bandwidth, least)) * normal(seed, *keys, F.lit(child))
    return out.withColumn(child, F.element_at("_p", at)[child] + noise).drop("_p", "_k", "_c", "_u")
