"""Evaluation tables: robust summaries, success rates, partitions by solvers, Pareto fronts, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def robust(df: DataFrame, keys: list[str], value: str, nonnegative: bool = False) -> DataFrame:
    """Count, interquartile mean, range, quartiles and clipped band of finite values per group (nulls are a group)."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(value) != float("inf")))
    if nonnegative:
        rows = rows.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    middle = (F.col("_i") >= F.floor(0.25 * F.col("_n"))) & (F.col("_i") < F.floor(0.75 * F.col("_n")))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.when(middle, F.col(value))), F.avg(value)).alias("iqm"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q"))
    out = out.select("*", F.get("_q", F.lit(0)).alias("q1"), F.get("_q", F.lit(1)).alias("median"), F.get("_q", F.lit(2)).alias("q3")).drop("_q")
    std = (F.col("q3") - F.col("q1")) / 1.349
    low = F.greatest(F.col("iqm") - std, F.col("min"))
    return out.select("*", (F.col("q3") - F.col("q1")).alias("iqr"), std.alias("iqr_std"), low.alias("low"), F.least(F.col("iqm") + std, F.col("max")).alias("high"))


def success(df: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """Totals and rate; attempts of unknown outcome do not count, groups of only such have a null rate."""
    return df.groupBy(*keys).agg(F.count(ok).alias("n_total"), F.sum(F.coalesce(F.col(ok).cast("int"), F.lit(0))).alias("n_ok")).withColumn("rate", F.try_divide(F.col("n_ok"), F.col("n_total")))


def partitions(attempts: DataFrame, query: str, method: str, ok: str) -> DataFrame:
    """``solvers, common, n, share``: queries by the exact set of methods that solved them.

    ``share`` is of all queries that not every method solved, those that none solved included.
    """
    solved = attempts.groupBy(query, method).agg(F.max(F.coalesce(ok, F.lit(False))).alias("_ok"))
    methods = F.broadcast(attempts.select(F.count_distinct(method).alias("_m")))  # one row
    sets = solved.groupBy(query).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("_ok"), F.col(method)))), "|").alias("solvers"), F.count_if("_ok").alias("_k"))
    sets = sets.crossJoin(methods).withColumn("common", F.col("_k") == F.col("_m"))
    counted = sets.groupBy("solvers", "common").agg(F.count("*").alias("n"))
    rest = F.sum(F.when(~F.col("common"), F.col("n")).otherwise(0)).over(Window.partitionBy())
    shares = counted.select("solvers", "common", "n", F.when(~F.col("common"), F.try_divide(F.col("n"), rest)).alias("share"))
    return shares.where("solvers <> ''")


def pareto(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rows that no other row of the group dominates (both at most, one less); equal rows all stay.

    A running minimum over x replaces the join of all pairs.
    """
    w = Window.partitionBy(*keys)
    strictly = F.min("_y").over(w.orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    lowest = df.groupBy(*keys, x).agg(F.min(y).alias("_y")).withColumn("_before", strictly).select(*keys, x, "_y", "_before")
    same = df.join(lowest, [*keys, x])
    return same.where((F.col(y) == F.col("_y")) & (F.col("_before").isNull() | (F.col("_before") > F.col(y)))).drop("_y", "_before")


def quantile_bins(df: DataFrame, value: str, bins: int = 4) -> DataFrame:
    """``df`` with ``bin``: right-closed quantile bins over distinct edges, the lowest value included; null without two edges."""
    cuts = ordered.percentiles(df, value, [i / bins for i in range(bins + 1)])
    edges = F.broadcast(cuts.select(F.array_distinct("values").alias("_edges")))  # one row
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    at = F.size(F.filter(inner, lambda e: e < F.col(value)))
    return df.crossJoin(edges).withColumn("bin", F.when((F.size("_edges") >= 2) & F.col(value).isNotNull(), at)).drop("_edges")


def bin_labels(edges: Column) -> Column:
    """A label for each bin between ``edges``: ``[a, b]`` for the first, ``(a, b]`` for the others, numbers with four significant digits."""

    def said(x: Column) -> Column:
        digits = F.when(x == 0, 3).otherwise(3 - F.floor(F.log10(F.abs(x)))).cast("int")
        scale = F.pow(F.lit(10.0), digits)
        text = F.regexp_replace(F.format_number(F.round(x * scale) / scale, 6), ",", "")
        return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")

    pairs = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda x, i: F.concat(F.when(i == 0, "[").otherwise("("), said(x), F.lit(", "), said(F.element_at(edges, i + 2)), F.lit("]")))
    return F.when(F.size(edges) >= 2, pairs)


def share(df: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Counts per ``keys`` and their share of the total of ``within``."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_r = 1").drop("_r")


def chunks(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """``df`` with ``run`` (consecutive equal keys) and ``chunk`` of at most ``size`` rows; a null key is a run of its own."""
    return ordered.runs(df, key, order, size)


def mean_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``n, mean, std`` (population) per group; nulls count in ``n`` alone."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def newest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group by ``order``: a replay buffer."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")


def jaccard_distance(a: Column, b: Column) -> Column:
    """One less the share that two arrays' sets have in common of what they have in all; 0 for two empty ones."""
    return F.coalesce(1 - F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def outcome_pivot(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of the named values of ``column`` as columns, 0 where there are none."""
    return df.groupBy(*keys).pivot(column, values).count().na.fill(0, values)
