"""Scalar functions of the model and of the report."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 1e6


def clamp_evidence(x: Column, limit: float = LIMIT) -> Column:
    """NaN becomes 0, and everything is held within the limits."""
    return F.greatest(F.least(F.when(F.isnan(x), F.lit(0.0)).otherwise(x), F.lit(limit)), F.lit(-limit))


def softplus(x: Column, least: float = 0.0) -> Column:
    """``ln(1 + e^x) + least`` without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)) + least


def stable_log(p: Column, eps: float = 1e-12) -> Column:
    return F.ln(F.greatest(p, F.lit(eps)))


def normal_log_density(x: Column, mean: Column, std: Column) -> Column:
    """Minus infinity where the standard deviation is not positive."""
    z = (x - mean) / std
    return F.when(std > 0, -0.5 * (z * z + 2 * F.ln(std) + math.log(2 * math.pi))).otherwise(F.lit(float("-inf")))


def normal_cdf(x: Column, mean: Column, std: Column) -> Column:
    """Normal distribution function by a rational approximation of the error function (absolute error below 2e-7)."""
    z = (x - mean) / (std * math.sqrt(2))
    t = 1 / (1 + 0.3275911 * F.abs(z))
    # fixed values: coefficients of the approximation
    c = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
    poly = reduce(lambda acc, k: acc * t + k, c[1:], F.lit(c[0])) * t
    erf = F.signum(z) * (1 - poly * F.exp(-z * z))
    return 0.5 * (1 + erf)


def normal_to_pmf(mean: Column, std: Column, k: int, least: float = 1e-12) -> Column:
    """Mass of a normal on the codes 0..k-1, half a code to each side, tails on the outer codes."""
    cuts = [normal_cdf(F.lit(i + 0.5), mean, std) for i in range(k - 1)]
    masses = [hi - lo for lo, hi in zip([F.lit(0.0), *cuts], [*cuts, F.lit(1.0)], strict=True)]
    spot = F.greatest(F.least(F.round(mean), F.lit(k - 1)), F.lit(0))
    one = F.array(*[F.when(spot == i, 1.0).otherwise(0.0) for i in range(k)])
    return F.when(std <= least, one).otherwise(F.array(*masses))


def slug(text: Column, limit: int = 120) -> Column:
    """Lower case, other characters than letters and digits as one underscore, a short digest instead of an overlong tail."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 9), F.lit("_"), F.substring(F.md5(text), 1, 8))).otherwise(s)


def stable_seed(seed: int, key: Column) -> Column:
    """``seed`` plus the first four bytes of the key's sha256 (little-endian), modulo 2^32."""
    h = F.sha2(key, 256)
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.pmod(F.conv(swapped, 16, 10).cast("long") + F.lit(seed), F.lit(1 << 32))


def nearest_in(x: Column, support: Column) -> Column:
    """The value of an array that lies nearest, the smaller of two equally near ones."""
    return F.array_min(F.transform(support, lambda v: F.struct(F.abs(x - v).alias("gap"), v.alias("v"))))["v"]
