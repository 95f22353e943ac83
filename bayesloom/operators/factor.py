"""Factors as tables of variables and ``p``: reduce, multiply, sum out, normalise, eliminate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Factor(NamedTuple):
    scope: list[str]
    table: DataFrame  # the scope's columns and p


def reduce_evidence(f: Factor, evidence: dict[str, object]) -> Factor:
    """Rows that agree with the evidence, without its variables."""
    own = [v for v in f.scope if v in evidence]
    table = f.table
    for v in own:
        table = table.where(F.col(v) == F.lit(evidence[v]))
    return Factor([v for v in f.scope if v not in own], table.drop(*own))


def multiply(a: Factor, b: Factor) -> Factor:
    """Natural join on shared variables with the product of ``p``."""
    shared = [v for v in a.scope if v in b.scope]
    right = b.table.withColumnRenamed("p", "_q")
    joined = a.table.join(right, shared) if shared else a.table.crossJoin(right)
    scope = [*a.scope, *[v for v in b.scope if v not in a.scope]]
    return Factor(scope, joined.select(*scope, (F.col("p") * F.col("_q")).alias("p")))


def sum_out(f: Factor, variable: str) -> Factor:
    rest = [v for v in f.scope if v != variable]
    return Factor(rest, f.table.groupBy(*rest).agg(F.sum("p").alias("p")))


def normalise(f: Factor) -> Factor:
    total = F.sum("p").over(Window.partitionBy())
    return Factor(f.scope, f.table.select(*f.scope, (F.col("p") / total).alias("p")))


def elimination_order(scopes: list[list[str]], keep: set[str], cards: dict[str, int] | None = None) -> list[str]:
    """Greedy order: next the variable whose elimination makes the smallest factor."""
    scopes_, order, cards = [set(s) for s in scopes], [], cards or {}
    left = sorted(set().union(*scopes_) - keep) if scopes_ else []
    while left:

        def weight(v: str) -> tuple[float, str]:
            joined = set().union(*[s for s in scopes_ if v in s]) - {v}
            size = 1.0
            for w in joined:
                size *= cards.get(w, 2)
            return size, v

        v = min(left, key=weight)
        left.remove(v)
        order.append(v)
        touched = [s for s in scopes_ if v in s]
        scopes_ = [s for s in scopes_ if v not in s] + ([set().union(*touched) - {v}] if touched else [])
    return order


def eliminate(factors: list[Factor], target: list[str], evidence: dict[str, object] | None = None, order: list[str] | None = None, cards: dict[str, int] | None = None) -> DataFrame:
    """Exact posterior of ``target``: buckets of joins, each summed before it is joined again."""
    left = [reduce_evidence(f, evidence or {}) for f in factors]
    for v in order or elimination_order([f.scope for f in left], set(target), cards):
        bucket = [f for f in left if v in f.scope]
        left = [f for f in left if v not in f.scope]
        if bucket:
            product = bucket[0]
            for f in bucket[1:]:
                product = multiply(product, f)
            left.append(sum_out(product, v))
    product = left[0]
    for f in left[1:]:
        product = multiply(product, f)
    return normalise(product).table.select(*target, "p")
