"""Counter-based random draws: a hash of what names the draw, so results never depend on partitioning or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int | float) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of the parts; the same in any SQL engine with md5."""
    key = F.concat_ws("|", *[(p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def fast_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from xxhash64: for volume, where no other engine has to agree."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(2**53))


def normal(*parts: Column | str | int | float) -> Column:
    """A standard normal draw by the Box-Muller transform of two uniform draws."""
    u1, u2 = uniform(*parts, F.lit("a")), uniform(*parts, F.lit("b"))
    return F.sqrt(-2 * F.ln(u1 + F.lit(0.5 / 4294967296.0))) * F.cos(2 * math.pi * u2)
