"""Work along an order without one task that holds all rows: ranges of the order, and what one range carries into the next.

Rows are dealt over ranges of their order and kept. Each range is worked on by itself; one summary row a range
says what it starts and ends with, and a window over those few rows gives what enters each of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.kept import kept


def ranged(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_part``, the number of the range of ``order`` that a row is in; equal rows by order share a range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def _entering(ends: DataFrame) -> DataFrame:
    """What each range inherits from the ranges before it: ``_part, _continues, _base, _carry``.

    ``ends`` has a row for each range: its first and last key, its number of runs and the length of its last one.
    """
    w = Window.orderBy("_part")
    rows = ends.withColumn("_continues", F.coalesce(F.lag("_last").over(w) == F.col("_first"), F.lit(False)))
    rows = rows.withColumn("_base", F.coalesce(F.sum(F.col("_runs") - F.col("_continues").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    through = F.col("_continues") & (F.col("_runs") == 1)  # the run goes on through the whole range
    rows = rows.withColumn("_island", F.sum((~through).cast("int")).over(w))
    rows = rows.withColumn("_open", F.sum("_tail").over(Window.partitionBy("_island").orderBy("_part")))
    carry = F.when(F.col("_continues"), F.lag("_open").over(w)).otherwise(0)
    return rows.select("_part", "_continues", (F.col("_base") - F.col("_continues").cast("long")).alias("_base"), carry.alias("_carry"))


def runs(df: DataFrame, key: str, order: list[str], size: int, ranges: int | None = None) -> DataFrame:
    """``df`` with ``run``, counted from 1 along ``order``, and ``chunk`` within the run, of at most ``size`` rows, from 0.

    A run is a row of consecutive equal keys; each row of a null key is a run of its own. ``order`` should tell rows
    apart: among equal ones any order is taken.
    """
    rows = ranged(df, order, ranges)
    w = Window.partitionBy("_part").orderBy(*order)
    new = F.coalesce(F.col(key) != F.lag(key).over(w), F.lit(True))
    rows = rows.withColumn("_run", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_part", "_run").orderBy(*order)))
    one = rows.groupBy("_part", "_run").agg(F.count("*").alias("_n"), F.first(key).alias("_key"))
    ends = one.groupBy("_part").agg(F.max("_run").alias("_runs"), F.min_by("_key", "_run").alias("_first"), F.max_by("_key", "_run").alias("_last"), F.max_by("_n", "_run").alias("_tail"))
    both = rows.join(F.broadcast(_entering(ends)), "_part")  # a row for each range
    place = F.col("_at") + F.when(F.col("_run") == 1, F.col("_carry")).otherwise(0)
    return both.withColumn("run", F.col("_base") + F.col("_run")).withColumn("chunk", F.floor((place - 1) / size).cast("int")).select(*df.columns, "run", "chunk")


def percentiles(df: DataFrame, value: str, shares: list[float], ranges: int | None = None) -> DataFrame:
    """One row with ``values``: the exact percentiles of a column, between its two nearest values where a share falls between them.

    Equal values are counted first; the counts are added up within ranges of the values, and what came before a range is a row of
    its own. Nulls do not count; without values the row holds null.
    """
    counts = ranged(df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), ["_v"], ranges)
    parts = counts.groupBy("_part").agg(F.sum("_n").alias("_s"))
    w = Window.orderBy("_part")  # a row for each range
    before = kept(parts.select("_part", (F.sum("_s").over(w) - F.col("_s")).alias("_before")))
    total = parts.agg(F.sum("_s")).first()[0]
    if not total:
        return df.sparkSession.range(1).select(F.lit(None).cast("array<double>").alias("values"))
    places = [s * (total - 1) for s in shares]
    wanted = sorted({int(f(p)) for p in places for f in (math.floor, math.ceil)})
    run = F.sum("_n").over(Window.partitionBy("_part").orderBy("_v"))
    rows = counts.join(F.broadcast(before), "_part").select("_v", (F.col("_before") + run).alias("_to"), (F.col("_before") + run - F.col("_n")).alias("_from"))
    hits = F.filter(F.array(*[F.lit(i).cast("long") for i in wanted]), lambda i: (i >= F.col("_from")) & (i < F.col("_to")))
    found = rows.where(F.size(hits) > 0).select(F.explode(hits).alias("_i"), "_v").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_at"))  # two for each share

    def at(p: float) -> Column:
        lo, hi = int(math.floor(p)), int(math.ceil(p))
        low, high = (F.element_at("_at", F.lit(i).cast("long")) for i in (lo, hi))
        return low if lo == hi else F.when(low == high, low).otherwise((hi - p) * low + (p - lo) * high)

    return found.select(F.array(*[at(p) for p in places]).alias("values"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str | None = None, most: Column | None = None, ranges: int | None = None) -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of its key that is not later, as a struct ``matched``, or null.

    ``most``, an expression over ``time`` and ``matched``, may say which matches count. Of several right rows of
    one time the greatest struct counts. A key of many rows spreads over ranges; the last right row of
    a range enters the next one. Null keys and times match nothing.
    """
    right_time = right_time or time
    payload = F.struct(F.col(right_time), *[F.col(c) for c in right.columns if c not in (key, right_time)])
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    kind = left.schema[time].dataType
    a = left.where(usable).select(F.struct(*left.columns).alias("_l"), F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_r"))
    b = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(key).alias("_k"), F.col(right_time).cast(kind).alias("_t"), F.lit(0).alias("_side"), payload.alias("_r"))
    rows = ranged(a.unionByName(b), ["_k", "_t", "_side"], ranges)
    w = Window.partitionBy("_part", "_k").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_here", F.last("_r", ignorenulls=True).over(w))
    # the last right row of each range's last key, and the key each range begins with
    ends = rows.groupBy("_part").agg(F.min("_k").alias("_first"), F.max("_k").alias("_lastkey"), F.max_by(F.when(F.col("_side") == 0, F.col("_r")), F.when(F.col("_side") == 0, F.struct("_k", "_t", "_r"))).alias("_r"), F.max(F.when(F.col("_side") == 0, F.col("_k"))).alias("_rk"))
    said = ends.select(F.col("_lastkey").alias("_k"), "_part", F.when(F.col("_rk") == F.col("_lastkey"), F.col("_r")).alias("_r"), F.lit(1).alias("_says"))
    hears = ends.select(F.col("_first").alias("_k"), "_part", F.lit(None).cast(said.schema["_r"].dataType).alias("_r"), F.lit(0).alias("_says"))
    carried = said.unionByName(hears).withColumn("_carry", F.last("_r", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_part", "_says")))
    carried = carried.where("_says = 0").select("_part", "_k", "_carry")
    matched = F.coalesce("_here", "_carry")
    found = rows.where("_side = 1").join(F.broadcast(carried), ["_part", "_k"], "left").select("_l.*", matched.alias("matched"))  # a row for each range
    if most is not None:
        found = found.withColumn("matched", F.when(most, F.col("matched")))
    return found.unionByName(left.where(~F.coalesce(usable, F.lit(False))).withColumn("matched", F.lit(None).cast(found.schema["matched"].dataType)))


def within(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, key: str | None = None) -> DataFrame:
    """All pairs of a point and an interval (of its ``key``, if given) with ``low <= at < high``.

    An interval's level is the power of two that its length does not exceed. It lies in at most two cells of that size; a
    point looks into one cell of each level that occurs. So neither long intervals nor dense points make many rows,
    and the join is on equal cells. Intervals that are empty, null or not finite match nothing.
    """
    length = F.col(high).cast("double") - F.col(low).cast("double")
    level = F.greatest(F.ceil(F.log2(length)), F.lit(-40)).cast("int")
    size = lambda l: F.pow(F.lit(2.0), l)
    usable = (length > 0) & (length < float("inf")) & ~F.isnan(length)
    spread = intervals.where(usable).withColumn("_level", level)
    # the last cell of a half-open interval may be one that it only touches; the exact test below sorts that out
    spread = spread.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low).cast("double") / size(F.col("_level"))), F.floor(F.col(high).cast("double") / size(F.col("_level"))))))
    levels = kept(spread.select("_level").distinct())  # at most some hundred numbers
    probes = points.where(F.col(at).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_cell", F.floor(F.col(at).cast("double") / size(F.col("_level"))))
    met = probes.join(spread, ["_level", "_cell", *([key] if key else [])])
    return met.where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("_level", "_cell")


def totals_within(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, value: str, key: str | None = None, ranges: int | None = None) -> DataFrame:
    """``intervals`` with ``n`` and ``total``: how many points (of its ``key``, if given) have ``low <= at < high``, and the sum of their ``value``.

    Totals up to an interval's high end less those up to its low end, so that no pair of a point and an interval is made.
    Ends and points, counted by place, lie in ranges of their order (equal ends share one); what one range carries into the next
    is a row for each of its keys. Sums are exact decimals of ten places: values must be finite, and null ones add nothing.
    Intervals that hold no point, or are empty, null or not finite, are left out, as by ``within``.
    """
    length = F.col(high).cast("double") - F.col(low).cast("double")
    usable = (length > 0) & (length < float("inf")) & ~F.isnan(length)
    number, k = "decimal(38,10)", F.col(key) if key else F.lit(0)
    rows = kept(intervals.where(usable).withColumn("_id", F.monotonically_increasing_id()))
    none = F.lit(0).cast("long"), F.lit(0).cast(number)
    # at equal places ends come first: a point there belongs to the interval that begins, and not to the one that closes
    ends = F.inline(F.array(*[F.struct(F.col(c).cast("double").alias("_x"), F.lit(sign).alias("_sign")) for c, sign in ((low, -1), (high, 1))]))
    ends = rows.select(k.alias("_k"), "_id", ends).select("_k", "_x", F.lit(0).alias("_side"), "_id", "_sign", none[0].alias("_n"), none[1].alias("_v"))
    own = points.where(F.abs(F.col(at).cast("double")) < float("inf")).groupBy(k.alias("_k"), F.col(at).cast("double").alias("_x")).agg(F.count("*").alias("_n"), F.coalesce(F.sum(F.col(value).cast(number)).cast(number), none[1]).alias("_v"))
    own = own.select("_k", "_x", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_id"), F.lit(None).cast("int").alias("_sign"), "_n", "_v")
    dealt = ranged(ends.unionByName(own).where("_k is not null"), ["_k", "_x", "_side"], ranges)
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range and key
    carried = dealt.groupBy("_part", "_k").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
    carried = carried.select("_part", "_k", F.coalesce(F.sum("_n").over(before), none[0]).alias("_n0"), F.coalesce(F.sum("_v").over(before).cast(number), none[1]).alias("_v0"))
    here = Window.partitionBy("_part", "_k").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = dealt.select("_part", "_k", "_id", "_sign", F.sum("_n").over(here).alias("_n"), F.sum("_v").over(here).cast(number).alias("_v")).where("_id is not null")
    upto = upto.join(carried, ["_part", "_k"]).select("_id", (F.col("_sign") * (F.col("_n") + F.col("_n0"))).alias("n"), (F.col("_sign") * (F.col("_v") + F.col("_v0"))).cast(number).alias("v"))
    found = upto.groupBy("_id").agg(F.sum("n").alias("n"), F.sum("v").cast("double").alias("total")).where("n > 0")
    return rows.join(found, "_id").drop("_id")
