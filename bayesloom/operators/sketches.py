"""Distinct counts from stored sketches: rows are read once, for a table of sketches by day and key; questions read that table.

HyperLogLog sketches answer how many there are in any union of days and keys, theta sketches also how many are in two
of them. Sketches of new days are added to the table; nothing already in it is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers (a power of two) of both kinds; the relative standard error of a union's estimate is about 1.04 / sqrt(2^BITS).
BITS = 12


def daily(df: DataFrame, day: Column, keys: list[str], value: str, bits: int = BITS) -> DataFrame:
    """``day, keys..., n, hll, theta``: a sketch of the distinct values of each day and key; null values count in ``n`` alone."""
    text = F.col(value).cast("string")
    rows = df.groupBy(day.alias("day"), *keys)
    return rows.agg(F.count("*").alias("n"), F.hll_sketch_agg(text, F.lit(bits)).alias("hll"), F.theta_sketch_agg(text, F.lit(bits)).alias("theta"))


def distinct(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by..., n, estimate``: distinct values in the union of all sketches of a group."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("hll", F.lit(True))).alias("estimate"))


def overlap(sketches: DataFrame, left: Column, right: Column, by: list[str] = (), bits: int = BITS) -> DataFrame:
    """``by..., left, right, both``: distinct values of two sets of sketches (conditions over their rows), and of what they share."""
    rows = sketches.groupBy(*by).agg(F.theta_union_agg(F.when(left, F.col("theta")), F.lit(bits)).alias("_a"), F.theta_union_agg(F.when(right, F.col("theta")), F.lit(bits)).alias("_b"))
    size = F.theta_sketch_estimate
    return rows.select(*by, size("_a").alias("left"), size("_b").alias("right"), size(F.theta_intersection("_a", "_b")).alias("both"))


def is_near(estimate: Column, exact: Column, bits: int = BITS, errors: float = 4.0) -> Column:
    """Whether an estimate is within so many standard errors of the exact count."""
    return F.abs(estimate - exact) <= F.lit(errors * 1.04 / 2 ** (bits / 2)) * exact + 1
