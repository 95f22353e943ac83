"""Workloads of queries: budgets, evidence drawn from pools, evidence values, query grids; state codes and answers on supports.

Every random choice is a hash of what it is for, so a workload is the same in any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import normal, uniform


def balanced_budget(categories: DataFrame, column: str, total: int, seed: int = 0) -> DataFrame:
    """``column, n``: ``total`` shared out evenly, the remainder to categories chosen by hash."""
    place = F.row_number().over(Window.orderBy(uniform(seed, column), column)) - 1  # one row for each category
    k = F.count("*").over(Window.partitionBy())
    return categories.select(column, (F.floor(F.lit(total) / k) + (place < F.lit(total) % k).cast("long")).alias("n"))


def drawn_evidence(queries: DataFrame, pool: DataFrame, target: str, node: str, member: str, most: int, seed: int = 0) -> DataFrame:
    """``query_id, member``: from the pool of each query's target, k members by hash, k drawn evenly from 0..``most`` (all, if fewer)."""
    k = F.floor(uniform(seed, "query_id", F.lit("k")) * (most + 1))
    rows = queries.select("query_id", F.col(target).alias("_t"), k.alias("_k")).join(pool.select(F.col(node).alias("_t"), member), "_t")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(uniform(seed, "query_id", member), member))
    return rows.withColumn("_r", place).where(F.col("_r") <= F.col("_k")).select("query_id", member)


def discrete_values(rows: DataFrame, states: str, seed: int, *keys: str) -> DataFrame:
    """``rows`` with ``code``: one of the first ``states`` (a column) whole numbers, evenly by hash."""
    return rows.withColumn("code", F.floor(uniform(seed, *keys) * F.col(states)).cast("int"))


def continuous_values(rows: DataFrame, seed: int, *keys: str, on_manifold: bool = True) -> DataFrame:
    """``rows`` (``low, high, mean, std``) with ``value``: normal and held within the range, or even over it."""
    inside = F.greatest(F.least(F.col("mean") + F.col("std") * normal(seed, *keys), F.col("high")), F.col("low"))
    even = F.col("low") + (F.col("high") - F.col("low")) * uniform(seed, *keys)
    return rows.withColumn("value", inside if on_manifold else even)


def query_grid(skeletons: DataFrame, modes: list[str], tasks: list[str], instances: int) -> DataFrame:
    """Each skeleton in every mode and task, ``instances`` times; without evidence once is enough."""
    mode = F.explode(F.array(*[F.lit(m) for m in modes])).alias("evidence_mode")
    rows = skeletons.select("*", mode).select("*", F.explode(F.array(*[F.lit(t) for t in tasks])).alias("task"))
    n = F.when(F.col("evidence_mode") == "empty", 1).otherwise(instances)
    return rows.withColumn("mc_id", F.explode(F.sequence(F.lit(0), n - 1)))


def encoded(df: DataFrame, domain: DataFrame, column: str, state: str = "state", code: str = "code") -> DataFrame:
    """``df`` with the code of each state; a state that the domain lacks is an error, null stays null."""
    known = domain.select(F.col(state).alias(column), F.col(code).alias("_c"))
    joined = df.join(known, column, "left")
    unknown = F.raise_error(F.concat(F.lit(f"{column} has no state "), F.col(column).cast("string"))).cast("int")
    return joined.withColumn(f"{column}_code", F.when(F.col(column).isNull(), F.lit(None).cast("int")).when(F.col("_c").isNull(), unknown).otherwise(F.col("_c"))).drop("_c")


def pmf_on_support(scored: DataFrame, keys: list[str], value: str, log_prob: str = "log_prob") -> DataFrame:
    """``keys, value, prob``: the softmax of log densities over each key's support."""
    w = Window.partitionBy(*keys)
    shifted = F.exp(F.col(log_prob) - F.max(log_prob).over(w))
    return scored.withColumn("_e", shifted).select(*keys, value, (F.col("_e") / F.sum("_e").over(w)).alias("prob"))


def direct_answer(queries: DataFrame, cpt: DataFrame, child: str, parents: list[str], do: str | None = None) -> DataFrame:
    """``query_id, child, prob`` by the table alone; where the target itself is set (``do``), all mass is on that value.

    Queries that lack a parent's value, or have one that the table lacks, get a null row.
    """
    rows = queries.join(cpt.select(*parents, child, "prob"), parents, "left") if parents else queries.crossJoin(cpt.select(child, "prob"))
    if do is None:
        return rows.select("query_id", child, "prob")
    fixed = F.col(do).isNotNull()
    prob = F.when(fixed, (F.col(child) == F.col(do)).cast("double")).otherwise(F.col("prob"))
    return rows.select("query_id", child, prob.alias("prob"))


def kernel_weighted(particles: DataFrame, evidence: dict[str, str], widths: dict[str, float]) -> DataFrame:
    """``particles`` with ``log_w``: unconditioned draws weighed by a normal kernel around each query's evidence columns."""
    log_w = F.lit(0.0)
    for v, column in evidence.items():
        log_w = log_w - 0.5 * ((F.col(v) - F.col(column)) / F.lit(widths[v])) ** 2
    return particles.withColumn("log_w", log_w)


def mean_slope(plus: DataFrame, minus: DataFrame, delta: float) -> DataFrame:
    """``query_id, slope``: the difference of two posteriors' means over twice the step of the intervention."""
    other = minus.select("query_id", F.col("mean").alias("_m"))
    return plus.join(other, "query_id").select("query_id", ((F.col("mean") - F.col("_m")) / (2 * delta)).alias("slope"))


def bin_geometry(bin_: Column, edges: Column, least: float = 1e-6) -> Column:
    """Left and right edge, width (``least`` at least) and centre of a bin."""
    left, right = F.element_at(edges, bin_ + 1), F.element_at(edges, bin_ + 2)
    return F.struct(left.alias("left"), right.alias("right"), F.greatest(right - left, F.lit(least)).alias("width"), ((left + right) / 2).alias("centre"))


def domain_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """``node, state, code``: the values of each column as text, numbered from 0 in their order."""
    seen = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("node"), F.col(c).cast("string").alias("state")) for c in columns])).alias("s")).select("s.*").where("state IS NOT NULL").distinct()
    return seen.withColumn("code", F.row_number().over(Window.partitionBy("node").orderBy("state")) - 1)


def table_queries(targets: DataFrame, pools: DataFrame, domain: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """``targets`` (``query_id, target, strategy``) with ``evidence``: a map from names to states, drawn by hash.

    ``pools`` are rows of ``strategy, target, member``. From 0 to ``most`` members (all, if fewer) of a query's pool are
    evidence, each in a state of the ``domain`` (``node, state, code``), every state alike likely. A target without a
    pool, and a member that the domain does not have, give no evidence.
    """
    k = F.floor(uniform(seed, "query_id", F.lit("k")) * (most + 1))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(uniform(seed, "query_id", "member"), "member"))
    sizes = domain.groupBy(F.col("node").alias("member")).agg(F.count("*").alias("_states"))
    picked = targets.select("query_id", "target", "strategy", k.alias("_k")).join(pools, ["strategy", "target"]).join(sizes, "member").withColumn("_r", place).where("_r <= _k")
    picked = picked.withColumn("code", F.floor(uniform(seed, "query_id", "member", F.lit("value")) * F.col("_states")).cast("int"))
    stated = picked.join(domain.withColumnRenamed("node", "member"), ["member", "code"])
    maps = stated.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("member", "state")))).alias("evidence"))
    return targets.join(maps, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.create_map().cast("map<string,string>")))
